"""run() of the corpus pipeline against a version in plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from soundings.llm import rules

from .test_hard_cases import brute_redact, brute_statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def near_groups(docs):
    """The documents that are the first of their group: five-word shingles, 80 of 100."""
    sets = {}
    for d in docs:
        w = [m[0] for m in WORD.finditer(re.sub("[A-Z]+", lambda m: m[0].lower(), d["text"] or ""))]
        sets[d["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return [d for d in docs if find(d["doc_id"]) == d["doc_id"]]


def copies_of(docs, most=3, weights=(1, 2, 3)):
    """doc_id -> how often the mix takes it: each source's stream in order of md5, repeated up to its share of all words."""
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d["doc_id"])
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    own = {s: sum(size[i] for i in by[s]) for s in names}
    share = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, open_, left = {}, list(names), float(sum(own.values()))
    while open_:
        level = left / sum(share[s] for s in open_)
        full = [s for s in open_ if most * own[s] <= level * share[s]]
        if not full:
            goal |= {s: level * share[s] for s in open_}
            break
        for s in full:
            goal[s] = float(most * own[s])
            left -= goal[s]
            open_.remove(s)
    out = {}
    for s in names:
        want, at = int(goal[s] + 0.5), 0
        for i in sorted(by[s], key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            if not size[i]:
                out[i] = 1
                continue
            taken = sum(max(0, min(at + k * own[s] + size[i], want) - (at + k * own[s])) for k in range(most))
            out[i] = int(taken / size[i] + 0.5)
            at += size[i]
    return out


def test_pipeline_equals_plain_python(spark, small):
    import corpus_pipeline
    import sentencepiece

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = rules.learn(docs, labels, ~rules.is_held_out(F.col("doc_id")))

    def score(text):
        x = brute_statistics(text)
        z = model.bias + sum(w for rule, w in model.rules if all((x[f] > cut) == above for f, above, cut in rule))
        return 1 / (1 + math.exp(-z))

    rows = [r.asDict() for r in docs.collect()]
    kept = near_groups([r for r in rows if score(r["text"]) >= 0.3])
    clean = [{**r, "text": None if r["text"] is None else brute_redact(r["text"])} for r in kept]
    copies = copies_of(clean)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for r in clean:
        ids = lib.encode(r["text"] or "")
        want[r["doc_id"], len(ids), tuple(ids)] += copies[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_pieces"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, small).collect())
    assert len(rows) > len(kept) > 100 and max(copies.values()) > 1
    assert got == +want
