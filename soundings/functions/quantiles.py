"""Exact percentiles of groups of any size, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import remove, written

BINS = 4096
#: Groups of at most so many values go through Spark's own percentile, which keeps a group's values in one task.
DIRECT = 1_000_000


def percentiles(df: DataFrame, column: str, shares: tuple[float, ...], keys: tuple[str, ...] = (), out: str = "q", direct: int = DIRECT, bins: int = BINS, fused: bool = False) -> DataFrame:
    """(*keys, out): an array of a column's percentiles (linear between neighbours), equal to F.percentile; null for groups without values.

    With `fused` the weighed values below and above are added with one rounding, as DuckDB's quantile_cont does (a fused
    multiply-add). That may move a percentile by a last place, which decides about values that stand on a fence made of it.

    Beyond `direct` values in a group the ranks that the percentiles lie between are searched for:
    each pass divides the bracket that holds a rank into `bins` parts of equal width, counts
    them map-side, and goes on with the part that holds the rank, cut down to the least and
    largest value in it, until one value is left. A part never holds the whole bracket,
    so it ends; values spread evenly over their range take three or four passes. A task
    sees at most `bins` counts of a bracket. Infinities are counted apart; NaN is the largest value.
    """
    x = F.col(column).cast("double") + 0.0  # one zero
    rows = df.select(*keys, x.alias("_x"))
    if (rows.groupBy(*keys).agg(F.count("_x").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= direct:
        if fused:
            return _by_counts(rows, shares, keys, out)
        return rows.groupBy(*keys).agg(F.percentile("_x", F.array(*map(F.lit, shares))).alias(out))

    wild = F.isnan("_x") | (F.abs("_x") == float("inf"))
    count = lambda c: F.count(F.when(c, 1))
    fine = F.when(~wild, F.col("_x"))
    base = rows.groupBy(*keys).agg(
        F.count("_x").alias("_n"), count(F.col("_x") == -float("inf")).alias("_least"), count(~wild).alias("_fine"), count(F.col("_x") == float("inf")).alias("_most"), F.min(fine).alias("_lo"), F.max(fine).alias("_hi"),
    )
    base = written(base, "groups")
    ranks = F.array(*(F.struct(F.lit(2 * i + j).alias("_t"), f(_place(s)).cast("long").alias("_rank")) for i, s in enumerate(shares) for j, f in enumerate((F.floor, F.ceil))))
    asked = base.where("_n > 0").select(*keys, "_least", "_fine", "_most", "_lo", "_hi", F.inline(ranks))
    special = F.when(F.col("_rank") < F.col("_least"), -float("inf")).when(F.col("_rank") >= F.col("_least") + F.col("_fine") + F.col("_most"), float("nan")).when(F.col("_rank") >= F.col("_least") + F.col("_fine"), float("inf"))
    state = asked.select(*keys, "_t", (F.col("_rank") - F.col("_least")).alias("_rank"), F.coalesce(special, "_lo").alias("_lo"), F.coalesce(special, "_hi").alias("_hi"))
    state = written(state, "brackets")
    while state.where("_lo < _hi").limit(1).count():
        after = written(state.where("NOT _lo < _hi").unionByName(_narrowed(rows, state.where("_lo < _hi"), keys, bins)), "brackets")
        remove(state)
        state = after

    found = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_t", "_lo"))).alias("_v"))
    at = lambda i: F.element_at("_v", F.lit(i))
    q = F.when(F.col("_n") > 0, F.array(*(_between(at(2 * i), at(2 * i + 1), s, fused) for i, s in enumerate(shares))))
    whole = _meet(base.select(*keys, "_n"), found, keys, "left") if keys else base.select("_n").join(found, how="left")
    return whole.select(*keys, q.alias(out))


def _place(share: float) -> Column:
    return (F.col("_n") - 1) * F.lit(float(share))


def _fma(x: Column, y: Column, z: Column) -> Column:
    """x * y + z rounded once: the product's and the sum's rounding errors, both exact, are added in the end; infinities pass."""

    def halves(v: Column) -> tuple[Column, Column]:
        big = v * 134217729.0
        top = big - (big - v)
        return top, v - top

    p = x * y
    (a, b), (c, d) = halves(x), halves(y)
    lost = b * d - (((p - a * c) - b * c) - a * d)
    s = p + z
    back = s - p
    rest = (p - (s - back)) + (z - back)
    whole = s + (rest + lost)
    return F.when(F.isnan(whole), s).otherwise(whole)


def _between(a: Column, b: Column, share: float, fused: bool) -> Column:
    """The percentile between the values at the ranks below and above its place."""
    low, high = F.floor(_place(share)), F.ceil(_place(share))
    under, over = high - _place(share), (_place(share) - low) * b
    return F.when(high == low if fused else (high == low) | (a == b), a).otherwise(_fma(a, under, over) if fused else under * a + over)


def _by_counts(rows: DataFrame, shares: tuple[float, ...], keys: tuple[str, ...], out: str) -> DataFrame:
    """Percentiles from running counts of a group's distinct values, added with one rounding."""
    counts = rows.groupBy(*keys, "_x").agg(F.count("_x").alias("_k"))
    whole = Window.partitionBy(*keys)
    placed = counts.withColumns({"_n": F.sum("_k").over(whole), "_upto": F.sum("_k").over(whole.orderBy("_x"))})
    at = lambda rank: F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_k")), F.col("_x")))
    ends = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *(at(f(_place(s))).alias(f"_v{2 * i + j}") for i, s in enumerate(shares) for j, f in enumerate((F.floor, F.ceil))))
    q = F.array(*(_between(F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), s, True) for i, s in enumerate(shares)))
    return ends.select(*keys, F.when(F.col("_n") > 0, q).alias(out))


def _meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joined on keys, null equal to null."""
    same = None
    for k in keys:
        one = left[k].eqNullSafe(right[k])
        same = one if same is None else same & one
    return left.join(right, same, how).select(*(left[c] for c in left.columns), *(right[c] for c in right.columns if c not in keys))


def _narrowed(rows: DataFrame, state: DataFrame, keys: tuple[str, ...], bins: int) -> DataFrame:
    """One pass: for each rank the part of its bracket that holds it, and the rank within that part."""
    brackets = state.select(*keys, "_lo", "_hi").distinct().groupBy(*keys).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_b"))  # at most two a share
    met = _meet(rows, brackets, keys) if keys else rows.crossJoin(F.broadcast(brackets))  # one row
    inside = met.select(*keys, "_x", F.inline(F.filter("_b", lambda b: F.col("_x").between(b["_lo"], b["_hi"]))))
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("_x")
    share = F.when(hi - lo < float("inf"), (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
    part = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("_part")
    counts = inside.groupBy(*keys, "_lo", "_hi", part).agg(F.count("*").alias("_k"), F.min("_x").alias("_from"), F.max("_x").alias("_to"))
    upto = F.sum("_k").over(Window.partitionBy(*keys, "_lo", "_hi").orderBy("_part"))
    ends = counts.withColumn("_upto", upto)
    back = _meet(state, ends, (*keys, "_lo", "_hi")).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_k")))
    return back.select(*keys, "_t", (F.col("_rank") - F.col("_upto") + F.col("_k")).alias("_rank"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"))
