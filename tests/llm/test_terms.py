"""Source divergence, language identification and spelling variants: awkward tables and brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundings.llm import _terms, divergence, languages, variants
from soundings.llm._words import Texts

from .conftest import edge_rows

LOWER = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LATIN = re.compile("[A-Za-zÀ-ÿ]+")
TEXT = st.text(st.characters(codec="utf-8") | st.sampled_from(" aAzZÀÿéĀ@[`{"), max_size=40)


@given(st.lists(TEXT | st.none(), max_size=6))
@settings(deadline=None)
def test_runs_are_those_of_the_patterns(texts):
    for pattern, wanted in ((TERM, _terms.letters), (LATIN, _terms.latin)):
        which, found = _terms.runs(Texts(pa.array(texts, pa.string())), wanted)
        assert [(int(i), w.decode()) for i, w in zip(which, found.to_pylist())] == [(i, LOWER(w)) for i, t in enumerate(texts) for w in pattern.findall(t or "")]


# ---- 11


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", TERM.findall(LOWER(text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        sources = {d[1] for d in own}
        n = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in sources}
        whole = Counter(t for d in own for t in d[2] if t in kept)
        p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p(n[s], t), p(n[o], t)) for t in kept), o) for o in sources - {s}]
            terms = [(f(p(n[s], t), p(whole, t)), t) for t in kept if n[s][t] and p(n[s], t) > p(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(items[:most], 1)]
    return sorted(out)


def test_audit_by_brute_force(spark, edge, nothing):
    got = sorted(tuple(r) for r in divergence.audit(edge, top=25).collect())
    assert got == brute_audit(edge_rows(), top=25) and len(got) > 40
    assert divergence.audit(nothing).count() == 0


def test_audit_of_many_equal_vectors(spark):
    """Terms with one vector tie; more of them than are wanted."""
    r = random.Random(3)
    words = [f"w{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"]
    rows = [(i, " ".join(words) if i % 4 == 0 else " ".join(r.choices(words, k=60)) + " Été 中", r.choice(["x", "y", None]), f"s{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(7)
    assert sorted(tuple(x) for x in divergence.audit(df, top=50).collect()) == brute_audit(rows, top=50)


def test_audit_without_kept_terms(spark):
    rows = [(1, "one two", "en", "a"), (2, "three", "en", "b"), (3, None, "en", "c"), (4, "12 34", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = sorted(tuple(r) for r in divergence.audit(df).collect())
    assert got == brute_audit(rows) and len(got) == 6 and {r[4] for r in got} == {0}


# ---- 12


def plain_network(net, text, size=languages.SEGMENT):
    """One byte after another."""
    k = net.inner.shape[2]
    total = np.zeros(len(net.langs))
    for at in range(0, len(text), size):
        x = list(text[at : at + size])
        hs = np.zeros((len(x), 2 * k))
        for way in (0, 1):
            h = np.zeros(k)
            for t in range(len(x)) if way == 0 else reversed(range(len(x))):
                g, u = net.table[way][:, x[t]].astype(float), net.inner[way].astype(float) @ h
                zr = 1 / (1 + np.exp(-2 * (g[: 2 * k] + u[: 2 * k])))
                h = h + zr[:k] * (np.tanh(g[2 * k :] + zr[k:] * (u[2 * k :] + net.bias[way][:, 0])) - h)
                hs[t, way * k : (way + 1) * k] = h
        p = np.exp(hs @ net.out.T.astype(float) + net.shift[:, 0])
        total += (p / p.sum(1, keepdims=True)).sum(0)
    return total / max(len(text), 1)


def network(seed=1, hidden=5):
    net = languages.blank(["aa", "bb", "cc"], hidden, seed)
    return net._replace(bias=np.random.default_rng(seed).standard_normal(net.bias.shape).astype(np.float32))


def test_pooled_probabilities_by_plain_steps():
    net, r = network(), np.random.default_rng(2)
    texts = [bytes(r.integers(0, 256, n).tolist()) for n in (1, 3, 63, 64, 65, 200, 1000)] + [b""]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = languages.pooled(net, data, ends)
    assert np.abs(got - np.stack([plain_network(net, t) for t in texts])).max() < 1e-5


def test_gradients_by_differences():
    net = network(4, 3)
    net = net._replace(**{n: getattr(net, n).astype(np.float64) for n in ("table", "inner", "bias", "out", "shift")})
    r = np.random.default_rng(5)
    x = r.integers(0, 256, (9, 4))
    x[6:, 1] = languages.PAD
    y = np.array([0, 1, 2, 0])
    _, grads = languages.gradients(net, x, y)
    for name, g in zip(("table", "inner", "bias", "out", "shift"), grads):
        a = getattr(net, name)
        places = [tuple(p) for p in np.argwhere(np.abs(g) > 0)]
        for p in r.permutation(len(places))[:25]:
            old, e = a[places[p]], 1e-5
            a[places[p]] = old + e
            up = languages.gradients(net, x, y)[0]
            a[places[p]] = old - e
            down = languages.gradients(net, x, y)[0]
            a[places[p]] = old
            assert abs((up - down) / (2 * e) - g[places[p]]) < 1e-6


def test_languages_held_out(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    got = languages.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    again = languages.learn(docs)
    assert all((a == b).all() for a, b in zip(again[1:], languages.learn(docs.repartition(5))[1:]))


def test_languages_edges(spark, edge, nothing):
    net = languages.learn(edge)
    assert net.langs == sorted({r[2] for r in edge_rows() if r[2] and r[1] and (r[0] is None or zlib.crc32(str(r[0]).encode()) % 3 != 1)})
    got = languages.identify(edge, net).collect()
    assert len(got) == len(edge_rows()) and {r["lang_pred"] for r in got} <= {*net.langs, "und"}
    silent = {i for i, t, *_ in edge_rows() if not any(c.isalpha() for c in t or "")}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == silent and {4, 5, 6, 18} <= silent
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert languages.predict(nothing).count() == 0
    none = languages.predict(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    one = languages.identify(edge, languages.learn(edge.where("lang = 'en'"))).where("doc_id = 1").first()
    assert one["lang_pred"] == "en" and one["score"] == 1.0


def test_passages_cover_texts(spark, edge):
    net = languages.learn(edge)
    got = defaultdict(list)
    for r in languages.passages(edge.where("doc_id NOT IN (15)"), net).collect():
        got[r["doc_id"]].append((r["start"], r["stop"], r["lang"]))
    texts = {i: t.encode() for i, t, *_ in edge_rows() if i and i != 15 and any(c.isalpha() for c in t or "")}
    assert got.keys() - {None} == texts.keys()
    for i, t in texts.items():
        spans = sorted(got[i])
        assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(spans, spans[1:]))


# ---- 13


def brute_variants(rows, least=7, times=2, factor=10):
    n = Counter()
    for doc_id, text in rows:
        for run in LATIN.findall(text or ""):
            w = LOWER(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= times}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) <= 1:
                if len(a) == len(b):
                    ok = sum(x != y for x, y in zip(a, b)) == 1
                else:
                    s, l = sorted((a, b), key=len)
                    i = next((i for i, (x, y) in enumerate(zip(s, l)) if x != y), len(s))
                    ok = s[i:] == l[i + 1 :]
                if ok:
                    near[a].add(b)
                    near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def spelling_rows(seed=2):
    """Words with chains of ever rarer neighbours, doubled letters, and words around the length from which keys carry numbers."""
    r = random.Random(seed)
    rows, words = [], []
    for base, most in (("aabbccdééx", 2600), ("wonderful", 400), ("×÷ÿÀÁbcdef", 40)):
        word, k = base, most
        while k >= 2:
            words += [word] * k
            i = r.randrange(len(word))
            word = r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("abzé") + word[i:], word[:i] + r.choice("qxz") + word[i + 1 :]])
            k //= r.choice([3, 10, 12])
    for n in (254, 255, 256, 257, 258, 400):
        long = "".join(r.choice("ab") for _ in range(n))
        words += [long] * 25 + [long[:7] + long[8:]] * 2 + [long[:-1] + "z"] * 2 + [long + "b"] * 3
    r.shuffle(words)
    for i in range(0, len(words), 40):
        rows.append((None if i == 0 else i, " ".join(w.upper() if r.random() < 0.2 else w for w in words[i : i + 40]) + " 7 Ābcdefgh"))
    return [*rows, (5, None), (6, ""), (7, "x" * 100_000)]


def test_variants_by_brute_force(spark, edge, nothing):
    rows = spelling_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("n")).repartition(5)
    got = sorted((tuple(r) for r in variants.group(df).collect()), key=lambda r: r[0])
    assert got == brute_variants(rows) and any(r[1] and r[2] != r[1] for r in got) and max(len(r[0]) for r in got) >= 400
    assert sorted(tuple(r) for r in variants.group(edge).collect()) == brute_variants([r[:2] for r in edge_rows()])
    assert variants.group(nothing).count() == 0


@given(st.lists(st.text("abé", min_size=1, max_size=9), min_size=1, max_size=12, unique=True))
@settings(deadline=None, max_examples=60)
def test_links_by_brute_force(words):
    """Keys, sorting and confirmation, whatever way batches cut the sorted keys."""
    part = pa.RecordBatch.from_pydict({"word": words, "name": words, "n": list(range(len(words)))})
    keys = pa.Table.from_batches(list(variants._spread(iter([part])))).sort_by([("key", "ascending"), ("place", "ascending")])
    want = {(a, b) for a in words for b in words if a != b and near(a, b)}
    for size in (1, 3, 1000):
        got = [(r["word"], r["near"]) for t in variants._link(iter(keys.combine_chunks().to_batches(max_chunksize=size))) for r in t.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def near(a, b):
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    return a in less(b) or b in less(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1


def test_crc32_of_any_length():
    r = np.random.default_rng(1)
    parts = [bytes(r.integers(0, 256, n).tolist()) for n in (0, 1, 5, 255, 256, 257, 5000)]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = variants.crc32(np.full(len(parts), zlib.crc32(b"9:"), np.uint32), ends, np.frombuffer(b"".join(parts), np.uint8))
    assert got.tolist() == [zlib.crc32(b"9:" + p) for p in parts]


@pytest.mark.parametrize("n", [1, 2, 40])
def test_equal_strings_have_equal_keys(n):
    w = "abé" * n
    starts, points = variants._points(pa.array([w, w[:-1], w + "q"]))
    whole, less = variants.deletion_keys(starts, points)
    assert less[starts[1] - 1] == whole[1] and less[-1] == whole[0] and whole[0] != whole[1]
