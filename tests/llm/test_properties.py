"""Properties of the kernels on arbitrary input."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from soundings.llm import minhash, pieces, repetition, urlfilter
from soundings.llm._words import Texts, shingles, words
from soundings.llm.licences import SEPARATOR, tokens

TEXT = st.text(st.characters(codec="utf-8") | st.sampled_from(" \t\n\x0b ab"), max_size=60)
MODEL = pieces.Pieces(open("/opt/tokenizers/piece_bpe_32k.model", "rb").read())


@given(st.lists(TEXT | st.none(), max_size=8))
@settings(deadline=None)
def test_words_are_those_of_the_pattern(texts):
    for separator, split in ((None, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)), (SEPARATOR, tokens)):
        t = Texts(pa.array(texts, pa.string()))
        first, s, e, _ = words(t) if separator is None else words(t, separator, lower=True)
        got = [t.bytes[a:b].tobytes().decode() for a, b in zip(s, e)]
        want = [split(x or "") for x in texts]
        if separator is not None:
            got = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in got]
        assert [got[a:b] for a, b in zip(first[:-1], first[1:])] == want


@given(st.lists(TEXT, min_size=1, max_size=4), st.integers(1, 5))
@settings(deadline=None)
def test_sets_do_not_depend_on_neighbours(texts, n):
    def sets(ts):
        first, _, _, h = words(Texts(pa.array(ts, pa.string())), lower=True)
        return [u.tolist() for u in shingles(first, h, n)]

    assert sets(texts) == [sets([t])[0] for t in texts]


@given(TEXT)
@settings(deadline=None)
def test_pieces_round_trip(text):
    ids = MODEL.encode(text)
    assert MODEL.decode(ids) == text.replace("▁", " ")


@given(st.lists(st.sampled_from("abc"), max_size=40))
@settings(deadline=None)
def test_suffix_array_is_sorted(w):
    n = len(w)
    if n:
        order, lcp = repetition.suffix_array(np.array([ord(c) for c in w]), n - np.arange(n))
        suffixes = ["".join(w[i:]) for i in order]
        assert suffixes == sorted(suffixes)
        for k in range(1, n):
            a, b = suffixes[k - 1], suffixes[k]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == same


@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=300), st.data())
@settings(deadline=None, max_examples=40)
def test_cascade_names_just_the_list(keys, data):
    h = np.array(sorted(keys), np.uint64)
    g = h * np.uint64(3) + np.uint64(1)
    listed = np.array(data.draw(st.lists(st.booleans(), min_size=len(h), max_size=len(h))))
    assert (urlfilter.look(urlfilter.build(h, g, listed), h, g) == listed).all()


@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=25))
@settings(deadline=None)
def test_shared_counts(sets):
    got = minhash._shared_counts([np.array(sorted(s)) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(a & b)
