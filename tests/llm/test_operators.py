"""Each operator on awkward tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.llm import embeddings, licences, minhash, mixing, pieces, queries, repetition, rules, secrets, sharding, urlfilter
from soundings.llm._words import Texts, shingles, words

from .conftest import edge_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def by_id(df):
    return sorted(([*r] for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, repr(r)))


# ---- words


def test_words_and_blocks(monkeypatch):
    import pyarrow as pa

    from soundings.llm import _words

    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n\u00e9\U0001f600") for _ in range(rng.randint(0, 90))) for _ in range(200)] + [None, "", "x" * 500]
    for block in (8, 64, 1 << 20):
        monkeypatch.setattr(_words, "BLOCK", block)
        t = Texts(pa.array(texts))
        first, s, e, h = words(t)
        got = [t.bytes[a:b].tobytes().decode() for a, b in zip(s, e)]
        want = [WORD.findall(x or "") for x in texts]
        assert [got[a:b] for a, b in zip(first[:-1], first[1:])] == want
        known = {}
        for w, x in zip(got, h):
            assert known.setdefault(w, x) == x
        assert len(set(known.values())) == len(known)
    sets = list(shingles(first, h, 2))
    assert [len(x) for x in sets] == [len(set(zip(w, w[1:]))) if len(w) > 1 else len(w) for w in want]


# ---- 1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")


def test_embeddings_edges(spark):
    a = [float(x) for x in np.random.default_rng(1).standard_normal(8)]
    b = [x + 0.01 for x in a]
    rows = [(1, a), (2, b), (3, None), (4, [0.0] * 8), (5, [float("nan")] * 8), (6, [None] * 8), (7, [-x for x in a]), (8, a), (8, a), (None, a), (9, [float("inf")] + a[1:]), (10, []), (11, [1.0, 2.0]), (12, [2.0, 4.0]), (13, [x * 1e-30 for x in a])]
    got = {(r[0], r[1], r[2], r[3]) for r in embeddings.groups(vectors(spark, [(*r, 1, "x") for r in rows])).collect()}
    assert (1, 4, 1, True) in got and (2, 4, 1, False) in got and (8, 4, 1, False) in got and (13, 4, 1, False) in got
    assert (11, 1, 11, True) in got and (12, 1, 11, False) in got
    for i in (3, 4, 5, 6, 7, 9, 10):
        assert (i, 0, i, True) in got
    assert (None, 0, None, True) in got
    assert embeddings.groups(vectors(spark, [])).count() == 0


@pytest.mark.parametrize("d, tile, wide", [(3, 8, 50), (16, 7, 13), (64, 8192, 65536)])
def test_embeddings_brute_force(spark, d, tile, wide):
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((12, d))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + 0.25 * rng.standard_normal((150, d)), centres]).astype(np.float32)
    x = np.concatenate([x, x[:5]])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.groups(vectors(spark, [(i, [float(v) for v in r], 0, "") for i, r in enumerate(x)]), tile=tile, wide=wide).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    root = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == root:
            break
        root = new
    assert got == {i: (int(near[i].sum()), root[i]) for i in range(len(x))}


# ---- 2


def test_sharding(spark, edge, nothing, small):
    got = sharding.shard(edge).collect()
    assert len(got) == len(edge_rows())
    for r in got:
        if r["doc_id"] == 14:
            assert r["text_crc32"] == zlib.crc32(("\u00e9t\u00e9 \U0001f600 " * 30).encode()) and r["size"] == len(("\u00e9t\u00e9 \U0001f600 " * 30).encode()) + 8
    assert sharding.shard(nothing).count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 2000)).unionByName(docs.limit(1).withColumn("doc_id", F.explode(F.sequence(F.lit(5000), F.lit(5200)))))
    r = sharding.shard(more, shards=5).toPandas()
    assert len(r) == more.count()
    for _, part in r.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    size = r.groupby("shard")["size"].sum()
    assert len(size) == 5 and size.max() - size.min() < 0.1 * size.mean()
    assert sorted(map(repr, sharding.shard(more, shards=5).toPandas().values.tolist())) == sorted(map(repr, r.values.tolist()))


# ---- 3


def test_licences(spark, edge, nothing):
    got = {r["doc_id"]: r for r in licences.scan(edge).collect()}
    r = got[16]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], r["score"]) == (7, 2, 3, 5, "mit", 1.0)
    assert got[4]["labels"] == "" and got[4]["first_word"] is None and got[10]["n_words"] == 150_000
    assert licences.scan(nothing).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    seqs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(4)]
    auto = licences.Automaton(seqs)
    parts = defaultdict(set)
    for s, q in enumerate(seqs):
        for i in range(len(q)):
            for j in range(i + 1, len(q) + 1):
                parts[tuple(q[i:j])].add((s, j - 1))
    for _ in range(100):
        run = [rng.randint(0, 3) for _ in range(15)]
        stat = [max((n for n in range(1, i + 2) if tuple(run[i - n + 1 : i + 1]) in parts), default=0) for i in range(len(run))]
        want = [(i, stat[i]) for i in range(len(run)) if stat[i] >= 2 and (i + 1 == len(run) or stat[i + 1] != stat[i] + 1)]
        found = list(auto.matches(run, 2))
        assert [(e, n) for e, n, _ in found] == want
        for e, n, state in found:
            assert auto.places[state] == parts[tuple(run[e - n + 1 : e + 1])]


def test_licence_with_changes(spark):
    assert licences.TEMPLATES[1][0] == "mit"
    text = licences.TEMPLATES[1][1]
    words_ = text.split()
    del words_[40:43]
    df = spark.createDataFrame([(1, "Intro. " + " ".join(words_)), (2, "the software is provided to any person"), (3, " ".join(words_[:10]))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licences.scan(df).collect()}
    assert got[1]["labels"] == "mit" and got[1]["score"] > 0.9 and got[1]["base_labels"] == "" and got[2]["labels"] == got[3]["labels"] == ""


# ---- 4


def brute_repeats(w, k=5):
    grams = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    cover = {p for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for p in range(i, i + k)}
    longest = 0
    while any(v > 1 for v in Counter(tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)).values()):
        longest += 1
    return len(cover), longest


def test_repetition(spark, edge, nothing):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 50)))) for i in range(150)]
    got = {r["doc_id"]: r for r in repetition.measure(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        cover, longest = brute_repeats(t.split())
        assert (got[i]["n_repeat_words"], got[i]["longest_repeat"]) == (cover, longest)
    assert repetition.measure(edge).count() == len(edge_rows()) and repetition.measure(nothing).count() == 0
    r = {r["doc_id"]: r for r in repetition.measure(edge).collect()}
    assert r[14]["word_chars"] == 120 and r[18]["n_symbols"] == 7 and r[4]["n_words"] == 0 and not r[4]["kept"]
    lines = spark.createDataFrame([(1, "a b\n\n a b\na b\n\n \n c\n c")], "doc_id long, text string")
    assert repetition.measure(lines).first()["n_dup_lines"] == 2


# ---- 5


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_cascade_is_exact(spark, bound):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    filters, n = urlfilter.cascade(keys, keys_per_shard=700)
    assert n > 1
    rows = keys.select("key", F.lit("x").alias("h"), F.col("listed").alias("shard")).unionByName(spark.createDataFrame([(None, None, None)], "key string, h string, shard boolean"))
    got = urlfilter.member(rows, "key", filters, n, "found", bound)
    assert got.count() == 3001 and got.where("found <> coalesce(shard, false)").count() == 0


def test_urls(spark):
    block_list = spark.createDataFrame([("tionsh.example.net",), ("tionsh.example.net",), (None,), ("not.in.the.corpus",)], "key string")
    rows = [(1, "HTTP://WWW.Example.ORG/es/1?x"), (2, "http://example.org/en/19"), (3, "http://a.org"), (4, None), (5, "no scheme"), (6, "http://tionsh.example.net/a#b"), (7, "http://x.com/fr/"), (7, "http://x.com/fr/"), (8, "a://b://c/d"), (9, "http://notorg/"), (10, "http://a.org/x\ny")]
    df = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    got = by_id(urlfilter.judge(df, queries.URL_RULES, block_list))
    assert [r[:5] for r in got] == [
        [1, "www.example.org", "/es/1", "example.org/es/", "block"], [2, "example.org", "/en/19", "example.org/en/1", "block"], [3, "a.org", "", None, "allow"], [4, "", "", None, "allow"], [5, "", "", None, "allow"],
        [6, "tionsh.example.net", "/a", None, "block"], [7, "x.com", "/fr/", "com/fr/", "allow"], [7, "x.com", "/fr/", "com/fr/", "allow"], [8, "b:", "//c/d", None, "allow"], [9, "notorg", "/", None, "allow"], [10, "a.org", "/x\ny", "org/", "allow"],
    ]
    assert urlfilter.judge(df.limit(0), queries.URL_RULES, block_list).count() == 0
    assert urlfilter.judge(df, queries.URL_RULES, block_list.limit(0)).where("in_list").count() == 0
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 2_000_000), (2, "x" * 2_000_000), (3, "http://" + "h" * 2_000_000)], "page_id long, url string")
    got = {r["page_id"]: r for r in urlfilter.judge(long, queries.URL_RULES, block_list).collect()}
    assert got[1]["rule"] == "org/" and len(got[1]["path"]) == 2_000_001 and got[2]["host"] == "" and len(got[3]["host"]) == 2_000_000


def test_link_farms_and_sizes(spark):
    pages = spark.createDataFrame([(1, "http://A.org/", "<a >" * 3 + "x" * 500), (2, "http://b.org/", "<a >" + "x" * 500), (3, "http://b.org/1", None), (4, None, "<a >" * 9), (5, "http://c.org", "")], "page_id long, url string, html string")
    assert [r["key"] for r in urlfilter.link_farms(pages).collect()] == ["a.org"]
    keys = spark.range(2000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    told = {r["level"]: r for r in urlfilter.sizes(urlfilter.cascade(keys)[0]).collect()}
    assert told[1]["hashes"] == 7 and 4000 <= told[1]["bits"] <= 4100 and all(told[n]["bits"] <= 2400 for n in told if n > 1)


# ---- 6

BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 12), ("access", re.compile("AKIA[A-Z0-9]+"), 18), ("hex", re.compile("[0-9a-f]+"), 16),
)


def base_spans(t):
    out = []
    for n, (kind, p, least) in enumerate(BASE):
        out += [(m.start(), n, kind, m.end()) for m in p.finditer(t) if len(m[2] if kind == "assign" else m[0]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_secrets(spark, edge, nothing):
    rng = random.Random(8)
    bits = ["password", "token", "API_KEY", "=", ": ", "'", '"', "abcdefghijklmnop", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", " ", "\n", "\u00e9", "\U0001f600", "user=bob ", "https://h.example/x ", "zz", "secret=secret=abcdefghijklmnop", "token=token:abcdefghijklmnop"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    got = {r["doc_id"]: r for r in secrets.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[i])
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
    assert secrets.report(edge).count() == len(edge_rows()) and secrets.report(nothing).count() == 0


def test_weak_parts_need_company(spark):
    rows = [(1, "user=bob"), (2, "user=bob password=hunter2"), (3, "password=hunter2"), (4, "https://db.example/x token=abcdefghijkl"), (5, "user=bob" + " x" * 200 + " password=hunter2"), (6, "client_id=" + "aB3" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r[5] for r in by_id(secrets.report(df))]
    assert got[0] == got[2] == got[4] == "" and got[1] == "id:0:8,pass:9:25" and got[3] == "endpoint:0:20,assign:21:39"
    assert "id:0:46" in got[5]
    red = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert red[1] == "user=bob" and red[2] == "[SECRET] [SECRET]" and red[4] == "[SECRET] [SECRET]"


def test_many_parts_in_one_text(spark):
    t = "token=abcdefghijklmnop " * 3000
    r = secrets.report(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r["n_assign"] == 3000


# ---- 7


def test_pieces_equal_the_library():
    import sentencepiece

    p = pieces.Pieces(open(MODEL, "rb").read())
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "b", "the", " ", "  ", "\n", "\u00e9", "\u65e5", "\U0001f600", "ing", ".", ",", "\x00", "\u2581", "Q", "1", "hello", "wor"]) for _ in range(rng.randint(0, 25)))
        assert p.encode(t).tolist() == lib.encode(t), repr(t)
        if "\u2581" not in t:
            assert p.decode(p.encode(t)) == t


def test_unigram_weights_equal_the_library():
    """The same pieces read as a unigram model: field 3 of the trainer's settings is the model type."""
    import sentencepiece

    raw = open(MODEL, "rb").read()
    out = bytearray()
    for number, value in pieces._fields(raw):
        if number == 2:
            body = bytearray()
            at = 0
            fields = list(pieces._fields(value))
            for n, v in fields:
                if n == 3 and isinstance(v, int):
                    v = 1
                if isinstance(v, int):
                    body += _varint(n << 3) + _varint(v)
                elif len(v) == 4 and n in (10, 11, 12, 13, 14, 15) and False:
                    body += _varint(n << 3 | 5) + v
            value = bytes(body)
        if isinstance(value, bytes):
            out += _varint(number << 3 | 2) + _varint(len(value)) + value
    lib = sentencepiece.SentencePieceProcessor(model_proto=bytes(out))
    p = pieces.Pieces(bytes(out))
    assert not p.bpe
    rng = random.Random(5)
    for _ in range(300):
        t = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 8))) for _ in range(6))
        a, b = p.encode(t).tolist(), lib.encode(t)
        weigh = lambda ids: sum(p.score[i] for i in ids)
        assert p.decode(np.array(b, np.int32)) == t and weigh(a) >= weigh(b) - 1e-3


def double_array(rules):
    """A compiled character map of a few rules: units placed one node after another."""
    texts, value = bytearray(), {}
    for k, v in rules.items():
        value[k.encode()] = len(texts)
        texts += v.encode() + b"\0"
    units, bases = {0: 0}, set()

    def place(at, label, key):
        below = sorted({k[len(key)] for k in value if len(k) > len(key) and k.startswith(key)})
        leaf = key in value
        offset = next(o for o in range(1, 1 << 20) if at ^ o not in bases and all(at ^ o ^ c not in units for c in [*below, *([0] if leaf else [])]))
        bases.add(at ^ offset)
        units[at] = label | leaf << 8 | offset << 10
        if leaf:
            units[at ^ offset] = value[key] | 1 << 31
        for c in below:
            units[at ^ offset ^ c] = 0
        for c in below:
            place(at ^ offset ^ c, c, key + bytes([c]))

    place(0, 0, b"")
    raw = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(-(-(max(units) + 1) // 256) * 256))  # whole kilobytes
    return len(raw).to_bytes(4, "little") + raw + bytes(texts)


def with_map(raw, blob, squeeze):
    out = bytearray()
    for number, value in pieces._fields(raw):
        if number == 3:
            value = b"\x0a\x01x" + b"\x12" + _varint(len(blob)) + blob + b"\x18\x01" + b"\x20" + bytes([squeeze])
        out += _varint(number << 3 | 2) + _varint(len(value)) + value
    return bytes(out)


@pytest.mark.parametrize("squeeze", [0, 1])
def test_character_map_equals_the_library(squeeze):
    import sentencepiece

    rules_ = {"A": "a", "AB": "x y", "\uff21": "A", "\u00a0": " ", "\t": " ", "\u200b": "", "e\u0301": "\u00e9", "\ufb01": "fi", "\n": " ", "zz": "z"}
    blob = double_array(rules_)
    assert pieces.character_map(blob) == rules_
    model = with_map(open(MODEL, "rb").read(), blob, squeeze)
    p, lib = pieces.Pieces(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(7 + squeeze)
    for _ in range(1500):
        t = "".join(rng.choice([*rules_, "B", "C", " ", "  ", "the", "z", "e", "\u65e5"]) for _ in range(rng.randint(0, 14)))
        assert p.encode(t).tolist() == lib.encode(t), repr(t)
        assert p.decode(p.encode(t)) == p.normalise(t)[1:].replace("\u2581", " ")


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def test_pieces_on_tables(spark, edge, nothing):
    got = pieces.encode(edge)
    assert got.count() == len(edge_rows()) and pieces.encode(nothing).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[4]["ids"] == [] and by[5]["n_pieces"] == 0 and not by[19]["round_trip"]
    assert all(r["round_trip"] for i, r in by.items() if i != 19)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(got.where("doc_id IS NOT NULL AND doc_id <> 19")).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in edge_rows() if i not in (None, 19))


# ---- 8


def test_quality_held_out(spark, middle, edge, nothing):
    docs, labels = spark.read.parquet(f"{middle}/documents.parquet"), spark.read.parquet(f"{middle}/labels.parquet")
    got = rules.classify(docs, labels)
    test = got.where("held_out").join(labels, "doc_id").toPandas()
    assert len(test) > 40 and (test["predicted"] == test["quality"]).mean() > 0.95
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    out = rules.classify(edge, labels)
    assert out.count() == len(edge_rows()) and out.where("score IS NULL OR predicted IS NULL OR held_out IS NULL").count() == 0
    assert rules.classify(nothing, labels).count() == 0
    assert {r["score"] for r in rules.classify(edge, labels.limit(0)).collect()} == {0.5}


def test_rule_columns_equal_numpy(spark, middle):
    docs, labels = spark.read.parquet(f"{middle}/documents.parquet"), spark.read.parquet(f"{middle}/labels.parquet")
    m = rules.learn(docs, labels, F.lit(True))
    s = rules._measured(docs.select("doc_id", "text")).select("quality_stats.*", m.score(F.col("quality_stats")).alias("p")).toPandas()
    assert len(m.rules) > 1 and np.allclose(m.predict(s[list(rules.FEATURES)].to_numpy()), s["p"])


# ---- 9


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    keys = sorted(sizes, key=lambda k: (k is None, (k or "").encode()))
    w = {k: weights[i % 3] for i, k in enumerate(keys)}
    total, target, free = sum(sizes.values()), {}, set(keys)
    left = total
    while True:
        all_w = sum(w[k] for k in free)
        over = {k for k in free if left * w[k] / all_w > most * sizes[k]} if free else set()
        if not over:
            return target | {k: left * w[k] / all_w for k in free}
        for k in over:
            target[k] = most * sizes[k]
            left -= target[k]
        free -= over


def test_mixing(spark, edge, nothing, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).when(F.col("doc_id") % 50 == 2, "").otherwise(F.col("source")))
    for df in (docs, edge):
        src = {(r["doc_id"], r["text"], r["source"]): 1 for r in df.collect()}
        sizes = defaultdict(int)
        for r in df.collect():
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        want = brute_targets(dict(sizes))
        got = mixing.mix(df, block_words=64).toPandas()
        assert len(got) == df.count() and src
        key = lambda k: "~" if k is None else "=" + k
        for k, t in want.items():
            part = got[got["skey"] == key(k)]
            assert abs(part["target"].iloc[0] - t) < 1e-6 * max(1, t) and abs(part["taken"].sum() - t) <= 1 and (part["taken"] <= 3 * part["size"]).all()
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("=a", 600), ("=b", 300), ("=c", 100), ("=d", 0)], "skey string, words long")
    got = mixing.schedule(goals, 1000).orderBy("slot").collect()
    assert [r["slot"] for r in got] == list(range(1000))
    for n in (100, 500, 1000):
        k = Counter(r["skey"] for r in got[:n])
        assert abs(k["=a"] - 0.6 * n) < 4 and abs(k["=b"] - 0.3 * n) < 4 and abs(k["=c"] - 0.1 * n) < 4
    for s in "abc":
        assert [r["rank"] for r in got if r["skey"] == f"={s}"] == list(range(next(r["slots"] for r in got if r["skey"] == f"={s}")))


# ---- 10


def brute_groups(rows, n, num=80, den=100):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and den * len(s & t) >= num * len(s | t):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 60, 400]))]
        for _ in range(rng.randint(1, 14)):
            w = [rng.choice(vocabulary) if rng.random() < 0.035 else x for x in base]
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), n=n).collect()}
    assert got == brute_groups(rows, n)


def test_minhash_edges(spark, edge, nothing):
    got = by_id(minhash.groups(edge, n=2))
    assert len(got) == len(edge_rows())
    by = {r[0]: r for r in got}
    assert by[1][2:] == [1, True] and by[2][2:] == [1, False] and by[3][2] == 1 and by[17][2] == 1 and by[8][2] == 7 and by[11][2] == 10
    assert by[4][1:] == [0, 4, True] and by[6][1:] == [0, 6, True]
    assert [r for r in got if r[0] == 15] == [[15, 2, 15, True]] * 2
    assert minhash.groups(nothing).count() == 0
    assert minhash.keep_first(edge).columns == edge.columns
    kept = [r["doc_id"] for r in minhash.keep_first(edge).collect()]
    assert kept.count(15) == 1 and 2 not in kept and 4 in kept


def test_estimate():
    rng = np.random.default_rng(1)
    for j in (0.5, 0.8, 0.95):
        err = []
        for _ in range(20):
            n = 3000
            both = rng.integers(0, 2**63, int(2 * n * j / (1 + j)), dtype=np.uint64)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) * np.uint64(2) for _ in "xy")
            err.append(minhash.estimate(minhash.registers(np.sort(x)), minhash.registers(np.sort(y)), len(x), len(y)) - len(both) / (2 * n - len(both)))
        assert abs(np.mean(err)) < 0.03


def test_clashing_columns(spark, edge, middle):
    """Extra columns named like inner ones pass through stages unchanged."""
    names = ["row", "once", "quality_stats", "near_dropped", "sec_base", "sec_all", "new", "some", "mix_id", "mix_k", "mix_copies", "mix_copy"]
    df = edge.select("doc_id", "text", "lang", "source", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    labels = spark.read.parquet(f"{middle}/labels.parquet")
    for got in (rules.accept(df, labels), minhash.keep_first(df), secrets.redact(df), mixing.mixed(df)):
        assert got.columns == df.columns and got.count() > 0
        assert all(r[n] == i for r in got.collect() for i, n in enumerate(names))


def test_near_copies_where_an_id_names_several_texts(spark):
    base = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abc"}
    near = {k: v + " more" for k, v in base.items()}
    # 5 names texts near to those of 1, 2 and 3 and one of its own; 7 names two near texts
    own = " ".join(f"own{i}" for i in range(60))
    pair = " ".join(f"pair{i}" for i in range(60))
    rows = [(1, base["a"]), (2, base["b"]), (3, base["c"]), (5, near["a"]), (5, near["b"]), (5, near["c"]), (5, own), (7, pair), (7, pair + " more"), (None, near["a"]), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.groups(docs).collect())
    assert got == [(0, 0, True), (0, 1, True), (1, 1, True), (2, 2, True), (3, 3, True), (5, 1, False), (5, 2, False), (5, 3, False), (5, 5, True), (7, 7, False), (7, 7, True)]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in minhash.keep_first(docs).collect())
    assert [i for i, _ in left] == [0, 0, 1, 2, 3, 5, 7] and (5, own) in left
