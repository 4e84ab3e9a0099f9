"""How far the sources of a language differ in their terms.

1. Each task counts terms per (lang, source) within slices of whole texts; Spark adds the
   counts up and gathers each term's sparse vector of (source, count), as long as the term has sources.
2. Terms of a language with the same vector count alike everywhere, so they become one vector
   with a multiplicity; all values are worked out once per vector.
3. A pair of sources is compared over all kept terms, those that neither has included. With
   p(0) for an absent term, f splits into f(0, 0) for every term, what a count on either side
   changes alone, and what counts on both sides change together. The first needs V, the second
   each source's own histogram of counts, the third the pairs of non-zero entries of each
   vector: work follows the non-zero entries, not sources squared times terms.
4. The best terms of a group: vectors are ranked, and only those of the first ranks are joined
   with their terms and ranked again.

All arithmetic is on integers. Sums of 64-bit values times multiplicities are kept in two halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from ._terms import letters, runs
from ._words import Texts, slices

SCALE = 1_000_000_000
BYTES = 8 << 20
_LOW = (1 << 30) - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, df), added up within slices of about BYTES of text."""
    for batch in batches:
        for part in slices(batch, BYTES, 2):
            which, found = runs(Texts(part.column(2)), letters)
            if not len(found):
                continue
            coded = found.dictionary_encode()
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            lang, source = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            own, times = np.unique(which * size + code, return_counts=True)  # one entry for each text and term
            key, at = np.unique(group[own // size] * size + own % size, return_inverse=True)
            g, term = np.divmod(key, size)
            l, s = np.divmod(g, len(source.dictionary))
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(l)), source.dictionary.take(pa.array(s)), coded.dictionary.take(pa.array(term)).cast(pa.binary()).cast(pa.string()),
                 pa.array(np.bincount(at, times).astype(np.int64)), pa.array(np.bincount(at))],
                ["lang", "source", "term", "n", "df"],
            )


def _p(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)); in decimals, as SCALE * n may exceed 64 bits."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", whole(n + 1) * F.lit(SCALE), whole(total + terms)) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _halves(value: Column, times: Column) -> list[Column]:
    """value * times as two longs that add up without overflow; value is under 2**62."""
    return [(F.shiftright(value, 30) * times).alias("high"), (value.bitwiseAND(F.lit(_LOW)) * times).alias("low")]


def terms(docs: DataFrame, least: int = 3) -> DataFrame:
    """lang, term, vec: for each term in at least `least` documents of a language its counts as an array of (source, n) by source."""
    d = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").where("text IS NOT NULL")
    counts = d.mapInArrow(_count, "lang string, source string, term string, n long, df long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return by_term.where(F.col("df") >= least).select("lang", "term", "vec")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how each source of a language differs from the others and in which terms.

    A term is a run of ASCII letters and characters beyond ASCII, A-Z lower-cased; kept are
    those in at least `least` documents (rows) of the language. p = 1 + floor(10**9 * (n + 1) / (N + V))
    with a group's counts n, their sum N over the V kept terms; f = floor((p - q)**2 / q).
    pair: for each other source of the language the sum of f over all kept terms, q the
    other's. term: for each term with n > 0 and p > q, q the language's, f, the first `top`.

    Null lang, source and text count as empty ones. Every (lang, source) of the table has its
    pairs, with value 0 where its language keeps no term. Repeated rows count each; equal
    values rank by item, as bytes; an empty table gives no rows; other columns are ignored.
    A task holds about eight times the bytes of its longest text.
    """
    kept = written(terms(docs, least), "audit-terms")
    vectors = kept.groupBy("lang", "vec").agg(F.count("*").alias("k")).withColumn("no", F.monotonically_increasing_id())
    vectors = written(vectors.withColumn("all_n", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"])), "audit-vectors")
    entries = vectors.select("lang", "no", "k", "all_n", F.explode("vec").alias("x")).select("lang", "no", "k", "all_n", "x.*")

    langs = vectors.groupBy("lang").agg(F.sum("k").alias("v"), F.sum(F.col("k") * F.col("all_n")).alias("lang_n"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("k") * F.col("n")).alias("source_n"))
    some = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = some.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "source_n"])
    zero = F.when(F.col("v") > 0, _p(F.lit(0).cast("long"), F.col("source_n"), F.col("v")))
    groups = written(groups.withColumn("zero", zero), "audit-groups")

    known = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "no", "k", "zero", _p(F.col("n"), F.col("source_n"), F.col("v")).alias("p"), _p(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("q")
    )
    return _pairs(known, groups).unionByName(_best(known, vectors, kept, top))


def _pairs(known: DataFrame, groups: DataFrame) -> DataFrame:
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"))
    p, zero, far = F.col("p"), F.col("zero"), F.col("other_zero")
    one = known.groupBy("lang", "source", "zero", "p").agg(F.sum("k").alias("k")).join(other, "lang").where("source <> item")
    mine = one.select("lang", "source", "item", *_halves(_f(p, far) - _f(zero, far), F.col("k")))
    theirs = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), *_halves(_f(far, p) - _f(far, zero), F.col("k")))
    held = known.groupBy("no", "lang", "k").agg(F.collect_list(F.struct("source", "zero", "p")).alias("a")).where(F.size("a") > 1)
    two = held.select("lang", "k", "a", F.explode("a").alias("x")).select("lang", "k", "x", F.explode("a").alias("y")).where("x.source <> y.source")
    a, a0, b, b0 = F.col("x.p"), F.col("x.zero"), F.col("y.p"), F.col("y.zero")
    both = two.select("lang", F.col("x.source").alias("source"), F.col("y.source").alias("item"), *_halves(_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0), F.col("k")))
    none = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", *_halves(F.coalesce(_f(zero, far), F.lit(0)), F.col("v")))
    wide = lambda n: F.sum(n).cast("decimal(38,0)")
    value = wide("high") * F.lit(1 << 30).cast("decimal(18,0)") + wide("low")
    sums = none.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(value.cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _best(known: DataFrame, vectors: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """Spark keeps the first `top` of a group in each partition before it brings the group together."""
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    first = known.where("p > q").select("lang", "source", "no", _f(F.col("p"), F.col("q")).alias("value")).withColumn("r", F.rank().over(by)).where(F.col("r") <= top)
    named = first.join(vectors.select("no", "vec"), "no").join(kept, ["lang", "vec"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return named.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
