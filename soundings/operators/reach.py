"""Reach summaries: distance windows, depth and width statistics, class shares, comparisons of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.quantiles import percentiles

QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)
NAMES = ("whisklo", "q1", "q2", "q3", "whiskhi")


def track_distance(points: DataFrame, keys: tuple[str, ...], order: str, x: str = "e", y: str = "n") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.coalesce(geo.distance(F.col(x), F.col(y), F.lag(x).over(w), F.lag(y).over(w)), F.lit(0.0))
    return points.withColumn("_s", step).withColumn("dist", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def stamps(points: DataFrame, length: float, dist: str = "dist") -> DataFrame:
    """A row for each window [k L, (k + 1) L] that a point lies in; a point on an edge lies in both."""
    k = F.floor(F.col(dist) / length)
    edge = (F.col(dist) == k * length) & (k > 0)
    return points.withColumn("stamp", F.explode(F.when(edge, F.array(k - 1, k)).otherwise(F.array(k))))


def full_stamps(stamped: DataFrame, keys: tuple[str, ...], length: float, dist: str = "dist", least: float = 0.75) -> DataFrame:
    """Without a last window that is filled to `least` or less."""
    ends = stamped.groupBy(*keys).agg(F.max(dist).alias("_far"), F.max("stamp").alias("_last"))
    df = stamped.join(ends, list(keys))
    return df.where((F.col("stamp") < F.col("_last")) | (F.col("_far") - F.col("_last") * length > least * length)).drop("_far", "_last")


def five_numbers(df: DataFrame, keys: tuple[str, ...], column: str, decimals: int = 2) -> DataFrame:
    """column_avg and the quantiles 0.01 .25 .5 .75 .99, rounded half-even."""
    got = df.groupBy(*keys).agg(F.avg(column).alias("_a"), F.percentile(column, F.array(*map(F.lit, QUANTILES))).alias("_q"))
    return got.select(*keys, F.bround("_a", decimals).alias(f"{column}_avg"), *(F.bround(F.col("_q")[i], decimals).alias(f"{column}_{n}") for i, n in enumerate(NAMES)))


def window_stats(df: DataFrame, keys: tuple[str, ...], column: str, decimals: int = 1) -> DataFrame:
    """min, max, mean, sample deviation and variance, median, and the mode of values rounded to `decimals` (the largest on ties)."""
    c, r = F.col(column), F.bround(column, decimals)
    base = df.groupBy(*keys).agg(
        F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.var_samp(c).alias("var"), F.percentile(c, F.lit(0.5)).alias("median")
    )
    mode = df.groupBy(*keys, r.alias("_v")).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max(F.struct("_n", "_v"))["_v"].alias("mode"))
    return base.join(mode, list(keys))


def sinuosity(df: DataFrame, keys: tuple[str, ...], order: str, x: str = "e", y: str = "n") -> DataFrame:
    """Track length over the straight line between its ends; null without a line."""
    d = track_distance(df, keys, order, x, y)
    ends = d.groupBy(*keys).agg(
        F.max("dist").alias("length"), *(f(c, order).alias(f"_{n}{c}") for n, f in (("a", F.min_by), ("b", F.max_by)) for c in (x, y))
    )
    line = geo.distance(F.col(f"_a{x}"), F.col(f"_a{y}"), F.col(f"_b{x}"), F.col(f"_b{y}"))
    return ends.withColumn("line", line).select(*keys, "length", "line", F.when(F.col("line") > 0, F.col("length") / F.col("line")).alias("sinuosity"))


def perpendicular(x: Column, y: Column, bearing: Column, right: Column, left: Column) -> Column:
    """The line across a track: from `left` metres on its left to `right` metres on its right."""
    t = F.radians(bearing + 90)
    p = lambda d: F.struct((x + d * F.sin(t)).alias("x"), (y + d * F.cos(t)).alias("y"))
    return F.array(p(-left), p(right))


def extend(ax: Column, ay: Column, bx: Column, by: Column, metres: float) -> Column:
    """The point `metres` beyond b on the line from a."""
    n = geo.distance(ax, ay, bx, by)
    return F.struct((bx + F.try_divide(bx - ax, n) * metres).alias("x"), (by + F.try_divide(by - ay, n) * metres).alias("y"))


def every(tracks: DataFrame, keys: tuple[str, ...], order: str, n: int = 50) -> DataFrame:
    return tracks.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).where(F.col("_i") % n == 0).drop("_i")


def melt(df: DataFrame, ids: list[str], columns: list[str], name: str = "substrate", value: str = "share") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def totals(areas: DataFrame, levels: tuple[str, str] = ("basin", "river"), value: str = "area") -> DataFrame:
    """Sum and count by river, by basin, and over all, in one pass; which level a row is stands in `level`."""
    a, b = levels
    areas = areas.select(a, b, value)
    return areas.groupingSets([[F.col(a), F.col(b)], [F.col(a)], []], F.col(a), F.col(b)).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def crossed(rows: DataFrame, left: DataFrame, right: DataFrame, value: str = "area") -> DataFrame:
    """count, min, max and sum for every pair of two dimensions' values; pairs without rows stay, with count 0. Both dimensions are name lists."""
    dims = left.crossJoin(right)
    keys = dims.columns
    return dims.join(rows, keys, "left").groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))


def difference(a: DataFrame, b: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    x, y = a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b"))
    return x.join(y, list(keys), "full_outer").withColumn("diff", F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))


def threshold_tally(df: DataFrame, share: str, area: str, keys: tuple[str, ...], cuts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Reaches, and their hard area, whose share exceeds each cut. A row is multiplied by the cuts, then summed."""
    rows = df.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).where(F.col(share) > F.col("cut"))
    return rows.groupBy(*keys, "cut").agg(F.count("*").alias("n"), F.sum(F.col(area) * F.col(share)).alias("hard_area"))


def within_percentiles(df: DataFrame, column: str, lo: float = 0.01, hi: float = 0.99, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows between two percentiles of all rows, or of their group where keys are given."""
    q = percentiles(df, column, (lo, hi), keys, "_q", fused=True)
    joined = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))  # without keys q is one row
    return joined.where(F.col(column).between(F.col("_q")[0], F.col("_q")[1])).drop("_q")


def within_whiskers(df: DataFrame, column: str, keys: tuple[str, ...] = (), scale: float = 1.5) -> DataFrame:
    """Rows strictly inside the whiskers (Q1 - 1.5 IQR, Q3 + 1.5 IQR) of all rows, or of their group."""
    q = percentiles(df, column, (0.25, 0.75), keys, "_q", fused=True)
    joined = df.join(q, list(keys)) if keys else df.crossJoin(F.broadcast(q))
    a, b = F.col("_q")[0], F.col("_q")[1]
    return joined.where((F.col(column) > a - scale * (b - a)) & (F.col(column) < b + scale * (b - a))).drop("_q")


def hard_share(df: DataFrame, cobble: str = "cobble", hard: str = "hard") -> DataFrame:
    return df.na.fill(0.0, [cobble, hard]).withColumn("hard_total", F.col(cobble) + F.col(hard))


def water_absorption(frequency_khz: Column, temperature: Column | float = 10.0, salinity: Column | float = 0.0, ph: float = 7.8, depth_m: float = 10.0) -> Column:
    """Absorption of sound in water in dB per metre: boric acid, magnesium sulphate and pure water terms."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    s = F.lit(salinity) if isinstance(salinity, (int, float)) else salinity
    z, f = depth_m / 1000, frequency_khz
    f1, f2 = 0.78 * F.sqrt(s / 35) * F.exp(t / 26), 42 * F.exp(t / 17)
    boric = F.when(f1 > 0, 0.106 * f1 * f * f / (f1 * f1 + f * f) * F.exp(F.lit((ph - 8) / 0.56))).otherwise(0.0)
    salt = 0.52 * (1 + t / 43) * (s / 35) * f2 * f * f / (f2 * f2 + f * f) * F.exp(F.lit(-z / 6))
    pure = 0.00049 * f * f * F.exp(-(t / 27 + z / 17))
    return (boric + salt + pure) / 1000


def basins(rows: DataFrame, mapping: DataFrame, river: str = "river") -> DataFrame:
    return rows.join(mapping, river, "left")


def river_code(name: Column) -> Column:
    return F.upper(F.split_part(name, F.lit("_"), F.lit(1)))
