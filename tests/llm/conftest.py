import random

import pytest


def edge_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows and ids."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeio") for _ in range(rng.randint(1, 6)))
    base = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(150_000))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base + " more", None, "a"), (4, None, "en", "a"), (5, "", "de", None), (6, " \n\t ", None, None),
        (7, "one", "en", "a"), (8, "one", "en", "c"), (9, "one two", "en", "c"), (None, base, "en", "a"), (None, None, None, None), (10, long, "fr", "b"), (11, long + " x", "fr", "b"),
        (12, "x" * 200_000, "en", "a"), (13, "password=abcdefghijkl \u00e9\u4e2d\U0001f600 token: 'zzz'", "en", "a"), (14, "\u00e9t\u00e9 \U0001f600 " * 30, "fr", "b"), (15, "A b A b A b A b A b A b A b A b", "en", "d"), (15, "A b A b A b A b A b A b A b A b", "en", "d"),
        (16, "Released under the MIT License. MIT license", "en", "d"), (17, base.upper(), "en", "e"), (18, "# $ % & | < >", "en", "e"), (19, "\x00 a\u2581b \x0b c", "en", "e"),
    ]
    return rows


NAMES = "n bigint, size string, shard double, words int, key string, bands string, sec_any int, h string, score string, v int, id long, mix_id int"


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(*r, *([1, "s", 0.5, 3, "k", "b", 1, "h", "q", 2, 5, 6])) for r in edge_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + NAMES).repartition(3)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
