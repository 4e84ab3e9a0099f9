"""Cases that break plain methods: repeats, long paths, many matches, heavy groups; and operators against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from soundings.llm import _graph, licences, minhash, rules, secrets, sharding
from soundings.llm._words import Texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- words


def test_thue_morse_words_differ():
    t = "0"
    while len(t) < 4096:
        t += "".join("10"[int(c)] for c in t)
    for n in (8, 64, 256, 257, 1024, 4096):
        a, b = ("".join(two[int(c)] for c in t[:n]) for two in ("ab", "ba"))
        h = words(Texts(pa.array([a, b, a.upper()])), lower=True)[3]
        assert h[0] != h[1] and h[0] == h[2]


# ---- components


def paths(n):
    p = list(range(n))
    random.Random(1).shuffle(p)
    return {
        "sorted": list(range(n)), "random": p, "valley": [*reversed(range(0, n, 2)), *range(1, n, 2)], "hill": [*range(0, n, 2), *reversed(range(1, n, 2))],
        "least at both ends": [0, *range(2, n), 1], "zigzag": [x for i in range(n // 2) for x in (i, n - 1 - i)],
    }


@pytest.mark.parametrize("name, n", [("random", 10_000), ("least at both ends", 1000), ("valley", 1000)])
def test_rounds_grow_with_the_logarithm_of_a_path(spark, monkeypatch, name, n):
    steps, real = [], _graph.written
    monkeypatch.setattr(_graph, "written", lambda df, what: steps.append(what) or real(df, what))
    p = paths(n)[name]
    got = _graph.components(spark.createDataFrame(list(zip(p, p[1:])), "u long, v long"))
    assert got.count() == n and got.where("root <> 0").count() == 0
    assert len(steps) <= 2 * (math.log2(n) + 3)


def test_components_of_random_graphs(spark):
    r = random.Random(3)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(700)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    got = {x["id"]: x["root"] for x in _graph.components(spark.createDataFrame([*edges, (None, 4), (5, None)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}
    assert _graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 2


def brute_tree(units, shards, grain):
    """(th, size, part) -> shard, by sorting: heavy units at their own weighted quantile, light ones where both sides come out even."""
    out = {}

    def go(first, n, light, heavy):
        if n == 1:
            out.update({u["ident"]: first for u in light + heavy})
            return
        reach = {d: max([u[d] >> 24 for u in light + heavy], default=0) - min([u[d] >> 24 for u in light + heavy], default=0) for d in sharding.DIMS}
        dim = max(sharding.DIMS, key=lambda d: reach[d])
        k = n // 2
        h = sorted(heavy, key=lambda u: u[dim])
        cuts = [sum(u["w"] for u in h[:i]) for i in range(len(h) + 1)]
        at = min(range(len(h) + 1), key=lambda i: (abs(cuts[i] - k / n * cuts[-1]), i))
        whole = sum(u["w"] for u in light)
        goal = min(max((whole + cuts[-1]) * k / n - cuts[at], 0), whole)
        rows = sorted(light, key=lambda u: u[dim])
        sums, i = [0], 0
        for u in rows:
            sums.append(sums[-1] + u["w"])
        i = next((j for j in range(1, len(sums)) if sums[j] >= goal), len(rows))
        if rows and sums[i] - goal > goal - sums[i - 1]:
            i -= 1
        go(first, k, rows[:i], h[:at])
        go(first + k, n - k, rows[i:], h[at:])

    heavy = [u for u in units if u["w"] > grain]
    go(0, shards, [u for u in units if u["w"] <= grain], sharding.level_weights(heavy, sum(u["w"] for u in units), shards))
    return out


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_equal_a_tree_by_sorting(spark, small, shards):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.rows_of(docs.unionByName(docs.limit(3).withColumn("doc_id", F.explode(F.sequence(F.lit(9000), F.lit(9040))))))
    parted, units, grain = sharding.units_of(rows, shards)
    known = [{**r.asDict(), "ident": (r["th"], r["size"], r["part"])} for r in units.collect()]
    want = brute_tree(known, shards, grain)
    got = {(r["th"], r["size"], r["part"]): r["shard"] for r in sharding._placed(units, *sharding.grow(units, shards, grain)).collect()}
    assert got == want


@pytest.mark.parametrize("sf", ["small", "middle"])
def test_equal_texts_share_a_shard(spark, request, sf):
    docs = spark.read.parquet(f"{request.getfixturevalue(sf)}/documents.parquet")
    got = sharding.shard(docs).join(docs.select("doc_id", "text"), "doc_id").toPandas()
    size = got.groupby("shard")["size"].sum()
    groups = got.groupby("text").agg(shards=("shard", "nunique"), bytes=("size", "sum"))
    assert (groups["shards"] == 1).all() and (groups["bytes"] < size.mean()).all()
    if groups["bytes"].max() < size.mean() / 2:
        assert size.max() - size.min() < 0.05 * size.mean()


def test_a_group_heavier_than_a_shard_is_spread(spark):
    rows = [(i, "the same text " * 20) for i in range(4000)] + [(10_000 + i, f"text {i} " * 30) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() - size.min() < 0.05 * size.mean()


# ---- 3


def brute_chain(scanner, found):
    """Per template the most words that any chain covers, by trying every one."""
    best = defaultdict(int)
    nodes = defaultdict(list)
    for end, length, state in found:
        for t, at in scanner.automaton.places[state]:
            nodes[t].append((end, length, at))

    def grow(t, last, covered):
        best[t] = max(best[t], covered)
        for end, length, at in nodes[t]:
            e, _, a = last
            if 0 < end - e and end - length - e < scanner.gap and 0 < at - a and at - length - a < scanner.gap:
                grow(t, (end, length, at), covered + min(length, at - a, end - e))

    for t in nodes:
        for x in nodes[t]:
            grow(t, x, x[1])
    return best


def test_chains_cover_as_much_as_any():
    rng = random.Random(9)
    for _ in range(150):
        spoken = [f"w{i}" for i in range(rng.choice([3, 6, 12]))]
        templates = tuple((f"l{i}", " ".join(rng.choice(spoken) for _ in range(rng.randint(4, 14)))) for i in range(3))
        s = licences.Scanner(templates, {}, least=2, gap=4, cover=0.6)
        number = {w: i for i, w in enumerate(sorted({w for _, t in templates for w in t.split()}))}
        text = []
        while len(text) < 20:
            text += rng.choice(templates)[1].split()[rng.randint(0, 4) : rng.randint(3, 14)] if rng.random() < 0.8 else ["other"]
        ids = np.array([number.get(w, -1) for w in text])
        found, at = [], 0
        for a, b in ((m.start(), m.end()) for m in re.finditer("k+", "".join("k" if i >= 0 else "." for i in ids))):
            if b - a >= 2:
                found += [(a + end, n, state) for end, n, state in s.automaton.matches(ids[a:b].tolist(), 2)]
        got = s.scan(ids)
        want = {t: min(1.0, n / s.lengths[t]) for t, n in brute_chain(s, found).items() if n >= 0.6 * s.lengths[t]}
        first = {}
        for t, lo, hi, part in got:
            assert 0 <= lo <= hi < len(text)
            first[t] = max(first.get(t, 0), part)
        assert first == pytest.approx(want)


def test_stray_matches_do_not_break_a_chain(spark):
    t = licences.TEMPLATES[1][1].split()
    stray = " ".join(t[10:15])
    text = " ".join([*t[:30], stray, *t[30:60], "or else", stray, *t[60:]])
    twice = " ".join([*t, "and", "again", *t])
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(1, text), (2, twice), (3, "the MIT License only"), (4, "w " * 50_000 + text)], "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] > 0.9 and got[4]["score"] == got[1]["score"]
    assert got[2]["spans"].count("mit:") >= 2 and got[3]["score"] == licences.PHRASE_SCORE and got[3]["spans"] == ""


def test_thousands_of_notices_in_one_text():
    s = licences.Scanner()
    number = {w: i for i, w in enumerate(sorted({w for _, t in licences.TEMPLATES for w in licences.tokens(t)} | {w for p in licences.PHRASES for w in p.split()}))}
    for sep in ([], ["and"]):
        one = [number.get(w, -1) for w in licences.tokens(licences.TEMPLATES[1][1]) + sep]
        got = [c for c in s.scan(np.array(one * 3000)) if c[0] == 1]
        assert len(got) == 3000 and all(c[3] > 0.99 for c in got)


def test_base_places_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for d in docs.collect():
        w = token.findall(re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        at = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


# ---- 6


def brute_spans(t, reach=200):
    found = []
    for pattern, kind, group in secrets.PATTERNS:
        for m in re.finditer(pattern, t, re.A):
            k = kind
            if kind == "assign":
                k = "assign" if len(m[group]) >= 12 else "pass" if len(m[group]) >= 4 else None
            if k:
                found.append((m.start(), secrets.KINDS.index(k), m.end()))
    secret = lambda x: secrets.ROLES[secrets.KINDS[x[1]]] == "s"
    base, weak = [x for x in found if x[1] < 3], [x for x in found if x[1] >= 3]
    kept = [w for w in weak if any(secret(o) != secret(w) and o[0] - w[2] <= reach and w[0] - o[2] <= reach for o in found) and not any(o[0] < w[2] and w[0] < o[2] for o in base)]
    return sorted(base + kept)


def brute_redact(t):
    out, at = [], 0
    for start, _, end in brute_spans(t):
        if start >= at:
            out += [t[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join(out) + t[at:]


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["password=", "hunter2 ", "token: ", "abcdefghijklmnop ", "AKIA", "ABCDEFGH12345678 ", "0123456789abcdef", "user=bob ", "client_id='x-1' ", "https://h.example/x ", "s3://b/k ", "aB3" * 12 + " ", "x " * 90, "\u00e9\U0001f600 ", "\n"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(500)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(df).collect()}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert len(got) == len(clean) == len(docs)
    for i, t in docs:
        want = brute_spans(t)
        assert got[i]["spans"] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in want), t
        assert got[i]["n_linked"] == sum(k >= 3 for _, k, _ in want) and clean[i] == brute_redact(t)


def test_matches_by_the_hundred_thousand_in_one_text(spark):
    t = "0123456789abcdef user=bob \u00e9 " * 40_000
    df = spark.createDataFrame([(1, t, 5), (2, "none", 4), (3, None, 0)], "doc_id long, text string, n_chars int")
    r = {x["doc_id"]: x for x in secrets.report(df).collect()}
    assert r[1]["n_hex"] == r[1]["n_linked"] == 40_000 and r[2]["spans"] == r[3]["spans"] == ""
    clean = {x["doc_id"]: x for x in secrets.redact(df).collect()}
    assert clean[1]["text"] == "[SECRET] [SECRET] \u00e9 " * 40_000 and clean[1]["n_chars"] == len(clean[1]["text"])
    assert clean[2]["text"] == "none" and clean[3]["text"] is None and clean[3]["n_chars"] == 0


# ---- 8


def brute_statistics(text):
    t = text or ""
    n = max(len(t), 1)
    w = re.split(r"[\x20\x09-\x0D]+", t.strip(" \t\n\x0b\x0c\r"))
    letters, lines = sum(map(len, w)), t.split("\n")
    count = lambda chars: sum(c in chars for c in t) / n
    return [
        len(t), len(w) if letters else 0, letters / len(w), count("#*$%&|<>!"), count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("0123456789"), len(set(w)) / len(w) if letters else 0,
        sum(a == b for a, b in zip(w, w[1:])) / len(w), len(lines) / n, 1 - len(set(lines)) / len(lines),
    ]


def test_scores_against_brute_force(spark, small, edge):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = rules.learn(docs, labels, ~rules.is_held_out(F.col("doc_id")))
    all_docs = docs.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    stats = rules._measured(all_docs).select("row.*", "quality_stats.*").collect()
    for r in stats:
        assert [r[f] for f in rules.FEATURES] == pytest.approx(brute_statistics(r["text"]))
    want = Counter()
    for r in stats:
        z = model.bias + sum(w for rule, w in model.rules if all((r[rules.FEATURES[f]] > cut) == above for f, above, cut in rule))
        want[r["doc_id"], round(1 / (1 + math.exp(-z)), 9)] += 1
    known = rules.classify(docs, labels)
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in known.collect())
    assert got and not got - want


def test_lasso_weights_are_optimal():
    rng = np.random.default_rng(2)
    x = rng.random((800, 10))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7) | (rng.random(800) < 0.1)).astype(float)
    m = rules.fit(x, y, lasso=5e-3)
    slope = m.predict(x) - y
    for rule, w in m.rules:
        a = rules._holds(rule, x).astype(float)
        assert abs((a - a.mean()) @ slope / len(y) + 5e-3 * np.sign(w)) < 5e-4
    assert 0 < len(m.rules) < 60 and ((m.predict(x) > 0.5) == y).mean() > 0.85


def test_one_word_repeated_any_number_of_times(spark, middle):
    labels = spark.read.parquet(f"{middle}/labels.parquet")
    counts = (1, 2, 1999, 2000, 20_000, 1_000_000)
    df = spark.createDataFrame([(i, n) for i, n in enumerate(counts)], "doc_id long, n int").select("doc_id", F.expr("repeat('spam ', n)").alias("text"))
    real = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").unionByName(df.withColumn("doc_id", F.col("doc_id") + 10_000_000))
    got = rules.classify(real, labels).where("doc_id >= 10000000")
    assert got.count() == len(counts) and got.where("score IS NULL").count() == 0
    kept = {r["doc_id"] for r in rules.accept(real, labels).where("doc_id >= 10000000").collect()}
    assert kept == {r["doc_id"] for r in got.where("score >= 0.3").collect()} and 10_000_005 not in kept


# ---- 10


def near_rows(seed, n_bases, most):
    rng = random.Random(seed)
    spoken = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(n_bases):
        base = [rng.choice(spoken) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(rng.randint(1, most)):
            rows.append((len(rows), " ".join(rng.choice(spoken) if rng.random() < 0.05 else x for x in base[: rng.randint(len(base) * 3 // 4, len(base))])))
    return rows


def brute_links(rows, n):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    return sets, [(i, j) for i, s in enumerate(sets) for j in range(i) if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])]


@pytest.mark.parametrize("sizes", [(3, 1_000_000, 1 << 22), (1024, 300, 0)])
def test_families_in_small_tiles(spark, monkeypatch, sizes):
    """One boilerplate family with many members below the threshold, tiles of a few sets, and texts found by a join."""
    for name, value in zip(("TILE_SETS", "TILE_SHINGLES", "BITMAP_IDS"), sizes):
        monkeypatch.setattr(minhash, name, value)
    rows = near_rows(11, 6, 40)
    sets, links = brute_links(rows, 2)
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), n=2).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(rows))}


def test_ids_with_several_texts_against_brute_force(spark):
    rows = near_rows(12, 12, 12)
    rng = random.Random(4)
    ids = [rng.choice([i, i // 3, None]) for i in range(len(rows))]
    sets, links = brute_links(rows, 2)
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in links:
        up[find(a)] = find(b)
    least = defaultdict(list)
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)].append(d)
    want = Counter((ids[i], len(sets[i]), min(least[find(i)], default=ids[i])) for i in range(len(rows)))
    df = spark.createDataFrame([(d, t) for d, (_, t) in zip(ids, rows)], "doc_id long, text string")
    got = minhash.groups(df, n=2).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    kept = {r["component_id"] for r in got if r["kept"] and r["doc_id"] is not None}
    assert kept == {c for d, _, c in want if d is not None}


def test_share_of_near_pairs_in_a_common_band():
    """Of pairs with J from 0.8 to 0.82, the hardest to find, all of 2,000 share a band."""
    rng = np.random.default_rng(8)
    missed = 0
    for _ in range(2000):
        n = int(rng.integers(30, 400))
        both = int(np.ceil(2 * n * 0.8 / 1.8))
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - both, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
        missed += not (minhash.bands(minhash.registers(a)) == minhash.bands(minhash.registers(b))).any()
    assert missed == 0
