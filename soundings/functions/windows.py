"""Window expressions over ordered pings: runs, unwrapping, rolling medians, interpolation."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("rec_id", "beam")


def along(keys: tuple[str, ...] = KEYS, order: str = "record_num") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def running_sum(x: Column, w: WindowSpec) -> Column:
    return F.sum(x).over(upto(w))


def run_id(index: Column, w: WindowSpec) -> Column:
    """0-based number of the maximal run of consecutive index values that a row belongs to."""
    return running_sum(F.when(index - F.lag(index).over(w) != 1, 1).otherwise(0), w)


def unwrap(df: DataFrame, angle: str, w: WindowSpec, out: str, period: float = 360.0) -> DataFrame:
    """Adds `out`: the angle without jumps of more than half a period; starts at the first value, skips nulls."""
    half = period / 2
    step = F.col(angle) - F.last(angle, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    turned = F.pmod(step + half, F.lit(period)) - half
    # a jump of exactly half a period keeps the sign it came with
    turned = F.when((turned == -half) & (step > 0), half).otherwise(turned)
    fix = F.when(F.abs(step) < half, 0.0).otherwise(turned - step)
    return df.withColumn("_fix", fix).withColumn(out, F.col(angle) + F.coalesce(running_sum(F.col("_fix"), w), F.lit(0.0))).drop("_fix")


def rolling_median(x: Column, w: WindowSpec, half: int = 15) -> Column:
    """Median of the 2 * half + 1 rows around each row (fewer at the ends), nulls left out."""
    return F.percentile(x, F.lit(0.5)).over(w.rowsBetween(-half, half))


def fill_linear(df: DataFrame, x: str, keys: tuple[str, ...], order: str, out: str, valid: Column | None = None) -> DataFrame:
    """Adds `out`: x, with rows that are null (or not `valid`) interpolated linearly by row position; ends are held.

    Values after a row are found on the reversed order, where the frame only grows, so both directions are linear in the rows.
    """
    fwd = Window.partitionBy(*keys).orderBy(order)
    rev = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    v = F.when(valid if valid is not None else F.lit(True), F.col(x))
    t = df.withColumns({"_v": v, "_i": F.row_number().over(fwd)}).withColumn("_p", F.when(F.col("_v").isNotNull(), F.col("_i")))
    t = t.withColumns({
        "_v0": F.last("_v", ignorenulls=True).over(upto(fwd)), "_p0": F.last("_p", ignorenulls=True).over(upto(fwd)),
        "_v1": F.last("_v", ignorenulls=True).over(upto(rev)), "_p1": F.last("_p", ignorenulls=True).over(upto(rev)),
    })
    a, b = F.col("_v0"), F.col("_v1")
    between = a + (b - a) * (F.col("_i") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    filled = F.when(F.col("_v").isNotNull(), F.col("_v")).when(a.isNull(), b).when(b.isNull(), a).otherwise(between)
    return t.withColumn(out, filled).drop("_v", "_i", "_p", "_v0", "_p0", "_v1", "_p1")


def as_of(rows: DataFrame, events: DataFrame, time: str, event_time: str, state: str, out: str, by: tuple[str, ...] = (), rank: str | None = None) -> DataFrame:
    """Adds `out`: the state of the latest event at or before each row's time, null before the first.

    Of events at one time the last by `rank` counts. Rows and events are merged into one sorted
    stream per `by` key and the state is carried forward: no join, whatever the number of events.
    """
    if rank:
        events = events.groupBy(*by, event_time).agg(F.max_by(state, rank).alias(state))
    if not by:
        return _as_of_all(rows, events, time, event_time, state, out)
    kind = rows.schema[time].dataType
    left = rows.select(F.struct("*").alias("_row"), *by, F.col(time).alias("_t"), F.lit(1).alias("_o"), F.lit(None).cast(events.schema[state].dataType).alias("_s"))
    right = events.select(F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *by, F.col(event_time).cast(kind).alias("_t"), F.lit(0).alias("_o"), F.col(state).alias("_s"))
    w = Window.partitionBy(*by).orderBy("_t", "_o")
    merged = left.unionByName(right).withColumn(out, F.last("_s", ignorenulls=True).over(upto(w)))
    return merged.where("_o = 1").select("_row.*", out)


def time_spans(rows: DataFrame, time: str, size: int = 250_000, most: int = 2048) -> list[float]:
    """Times that cut rows into spans of about `size` rows, at most `most` of them, from a sketch of their quantiles; a time held by many rows comes several times."""
    n = rows.agg(F.count(time)).first()[0]
    spans = min(most, n // size + 1)
    if spans < 2:
        return []
    shares = F.array(*(F.lit(i / spans) for i in range(1, spans)))
    return rows.agg(F.percentile_approx(F.col(time).cast("double"), shares, F.lit(8 * spans))).first()[0]


def span_of(time: Column, cuts: list[float], first: bool = False) -> Column:
    """The span of a time: that after the cuts before it. Rows at a cut that comes several times are dealt over the spans between; with `first` they get the first of these."""
    if not cuts:
        return F.lit(0)
    at = np.array(cuts)

    @F.pandas_udf("int")
    def find(t: pd.Series) -> pd.Series:
        x = t.to_numpy(float)
        low = np.searchsorted(at, x, "left")
        if first:
            return pd.Series(low.astype(np.int32))
        room = np.searchsorted(at, x, "right") - low + 1
        return pd.Series((low + np.arange(len(x)) % room).astype(np.int32))

    return find(time.cast("double"))


def _as_of_all(rows: DataFrame, events: DataFrame, time: str, event_time: str, state: str, out: str, size: int = 250_000) -> DataFrame:
    """as_of() over one sequence of events for all rows: within spans of about `size` rows, with the state that earlier spans leave behind.

    The spans follow the rows' times, however these are spread, and rows of one time may be in several spans; the
    events of a time are in the first of these, whose end the later ones start from.
    """
    cuts = time_spans(rows, time, size)
    told = events.where(F.col(event_time).isNotNull())
    if not cuts:
        return as_of(rows.withColumn("_span", F.lit(0)), told.withColumn("_span", F.lit(0)), time, event_time, state, out, ("_span",)).drop("_span")
    told = told.withColumn("_span", span_of(F.col(event_time), cuts, first=True))
    last = told.where(F.col(state).isNotNull()).groupBy("_span").agg(F.max_by(state, event_time).alias("_left"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    spans = rows.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_span"))
    carry = spans.join(last, "_span", "left").withColumn("_carry", F.last("_left", ignorenulls=True).over(before)).drop("_left")
    inside = as_of(rows.withColumn("_span", span_of(F.col(time), cuts)), told, time, event_time, state, out, ("_span",))
    return inside.join(carry, "_span", "left").withColumn(out, F.coalesce(out, F.when(F.col(time).isNotNull(), F.col("_carry")))).drop("_span", "_carry")


def island_lengths(index: Column, w: WindowSpec, keys: tuple[str, ...], df: DataFrame) -> DataFrame:
    """Adds _run and _len: the run of consecutive index values and its number of rows."""
    return df.withColumn("_run", run_id(index, w)).withColumn("_len", F.count("*").over(Window.partitionBy(*keys, "_run")))


def radians(x: Column) -> Column:
    return x * (math.pi / 180)


def by_kernel(df: DataFrame, keys: tuple[str, ...], order: str, columns: tuple[str, ...], out: dict[str, str], run: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """df with the columns `out` (name -> type) that run() adds to each group's `columns`, in order.

    Only `columns` go through Python. Rows are matched by their place in the group; rows that tie
    in `order` are placed by `columns`, so it does not matter which of equal ones gets which place.
    """
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *(c for c in columns if c != order))))
    lean = placed.select(*keys, "_at", *(c for c in columns if c not in keys))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema if f.name in (*keys, "_at")) + "".join(f", `{n}` {t}" for n, t in out.items())

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        return run(part.sort_values("_at"))[[*keys, "_at", *out]]

    made = lean.groupBy(*keys).applyInPandas(kernel, kind)
    same = [placed[k].eqNullSafe(made[k]) for k in keys]
    return placed.join(made, [*same, placed["_at"] == made["_at"]]).select(*(placed[c] for c in df.columns if c not in out), *(made[c] for c in out))
