"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are fitted to a bounded sample of labelled rows; every path from a
root to a node is a conjunctive rule. A logistic model with a lasso penalty weighs the
rules, most of which get none. What is left compiles to one Spark column, so scoring is a
scan of the texts without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
FEATURES = ("chars", "words", "word_chars", "symbols", "capitals", "digits", "distinct", "again", "lines", "same_lines")
#: Bound of the labelled sample, taken by the order of a hash of doc_id.
SAMPLE = 20_000


def statistics(text: Column) -> Column:
    """A struct of FEATURES: shares are of code points, words or lines; all but chars and lines are 0 for null, empty or blank text.

    `again` is the share of words equal to the word before them. No pattern here repeats a
    group, so the stack a text needs does not depend on its length.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.split(F.btrim(t, F.lit(" \t\n\x0b\x0c\r")), WHITE)  # blank text: one empty word

    def told(x: Column) -> Column:
        w, lines = x["words"], x["lines"]
        n = F.greatest(F.length(t), F.lit(1)).cast("double")
        gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n
        letters = F.length(F.array_join(w, ""))
        k, m = F.size(w).cast("double"), F.size(lines).cast("double")
        twins = F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda same: same)
        return F.struct(
            F.length(t).cast("double").alias("chars"),
            F.when(letters > 0, k).otherwise(F.lit(0.0)).alias("words"),
            (letters / k).alias("word_chars"),
            gone(r"[#*$%&|<>!]+").alias("symbols"),
            gone("[A-Z]+").alias("capitals"),
            gone("[0-9]+").alias("digits"),
            F.when(letters > 0, F.size(F.array_distinct(w)) / k).otherwise(F.lit(0.0)).alias("distinct"),
            (F.size(twins) / k).alias("again"),
            (m / n).alias("lines"),
            (F.lit(1.0) - F.size(F.array_distinct(lines)) / m).alias("same_lines"),
        )

    # One lambda call binds the split words and lines, so each text is split once.
    return F.transform(F.array(F.struct(words.alias("words"), F.split(t, "\n").alias("lines"))), told)[0]


Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, threshold), all of which hold


@dataclass
class Model:
    bias: float
    rules: list[tuple[Rule, float]]

    def score(self, stats: Column) -> Column:
        """The probability of label 1, as a column over a statistics() struct."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for f, above, cut in rule:
                x = stats[FEATURES[f]]
                holds = holds & ((x > cut) if above else (x <= cut))
            z = z + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _holds(rule, x)
        return 1 / (1 + np.exp(-z))


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return out


def _split(x: np.ndarray, r: np.ndarray, least: int) -> tuple[int, float] | None:
    """The (feature, threshold) that lowers the squared error of r most; thresholds are midpoints of quantiles."""
    best, gain = None, 1e-9
    n, total = len(r), r.sum()
    for f in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)))
        if len(v) < 2:
            continue
        cuts = (v[1:] + v[:-1]) / 2
        bin_ = np.searchsorted(cuts, x[:, f], "left")
        k = np.cumsum(np.bincount(bin_, minlength=len(v)))[:-1]
        s = np.cumsum(np.bincount(bin_, weights=r, minlength=len(v)))[:-1]
        ok = (k >= least) & (n - k >= least)
        if ok.any():
            g = np.where(ok, s**2 / np.maximum(k, 1) + (total - s) ** 2 / np.maximum(n - k, 1) - total**2 / n, -1)
            i = int(g.argmax())
            if g[i] > gain:
                best, gain = (f, float(cuts[i])), g[i]
    return best


def _grow(x: np.ndarray, r: np.ndarray, at: np.ndarray, path: Rule, depth: int, rules: list[Rule], leaves: list[tuple[Rule, float]], least: int) -> None:
    cut = _split(x[at], r[at], least) if depth else None
    if cut is None:
        leaves.append((path, float(r[at].mean())))
        return
    for above in (False, True):
        side = at[(x[at, cut[0]] > cut[1]) == above]
        rule = (*path, (cut[0], above, cut[1]))
        rules.append(rule)
        _grow(x, r, side, rule, depth - 1, rules, leaves, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, lasso: float = 5e-4, seed: int = 11) -> Model:
    """Rules from boosted trees on half samples, then lasso logistic weights by accelerated proximal steps."""
    if not len(y):
        return Model(0.0, [])
    rng = np.random.default_rng(seed)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate / (1 - rate)))
    if y.min() == y.max():
        return Model(base, [])
    rules: list[Rule] = []
    f = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        leaves: list[tuple[Rule, float]] = []
        _grow(x, y - p, np.sort(rng.permutation(len(y))[: max(2, len(y) // 2)]), (), depth, rules, leaves, max(5, len(y) // 1000))
        for path, value in leaves:
            f += 2.0 * value * _holds(path, x)
    columns: dict[bytes, Rule] = {}
    for rule in rules:
        h = _holds(rule, x)
        columns.setdefault(np.packbits(h if h[0] else ~h).tobytes(), rule)  # a rule and its opposite count once
    kept = list(columns.values())
    a = np.stack([_holds(r, x) for r in kept], 1).astype(np.float64)
    mean = a.mean(0)
    a -= mean
    w, b = np.zeros(a.shape[1]), base
    v, c, t = w.copy(), b, 1.0
    step = 4.0 * len(y) / (np.linalg.norm(a.T @ a, 2) + len(y))
    for _ in range(600):
        g = (1 / (1 + np.exp(-(a @ v + c))) - y) / len(y)
        w2 = v - step * (a.T @ g)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * lasso, 0)
        b2 = c - step * g.sum()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Model(float(b - w @ mean), [(r, float(x)) for r, x in zip(kept, w) if abs(x) > 1e-6])


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled rows for which `allowed` (a predicate on doc_id) holds.

    Null labels are ignored; several labels of a doc_id count by majority (ties: 1); a doc_id
    with several texts gives a row for each, and of all rows the first `sample` by hash count.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    few = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, hence the broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.xxhash64("doc_id").alias("h"), "doc_id", statistics(F.col("text")).alias("s"), "quality")
    got = rows.select("h", "doc_id", "s.*", "quality").orderBy("h", "doc_id", *FEATURES).limit(sample).toPandas()
    return fit(got[list(FEATURES)].to_numpy(np.float64), got["quality"].to_numpy(np.float64))


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _measured(docs: DataFrame) -> DataFrame:
    """row (the columns of docs as a struct) and quality_stats. These pass through a generator, so that the optimiser does not compute them again for each rule."""
    once = docs.select(F.struct("*").alias("row"), statistics(docs["text"]).alias("once"))
    return once.select("row", F.explode(F.array("once")).alias("quality_stats"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row. Other columns of docs are ignored; without labels every score is a half."""
    model = learn(docs, labels, ~is_held_out(F.col("doc_id")))
    stats = _measured(docs.select("doc_id", "text"))
    return stats.select("row.doc_id", is_held_out(F.col("row.doc_id")).alias("held_out"), model.score(F.col("quality_stats")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The docs that the classifier does not reject, with all their columns.

    Null, empty and blank texts are scored by their statistics like others; rows with a null
    doc_id too. Repeated rows share a score; without labels every score is a half, so all
    stay; an empty table stays empty.
    """
    model = learn(docs, labels, ~is_held_out(F.col("doc_id")))
    return _measured(docs).where(model.score(F.col("quality_stats")) >= threshold).select("row.*")
