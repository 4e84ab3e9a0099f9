"""Depth picks: cleaning, smoothing, agreement of the two sides, bed detection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import KEYS, along, by_kernel, fill_linear, rolling_median
from . import kernels
from .tracks import side_key


def outliers(
    pings: DataFrame, depth: str = "dep_m", sensor: str | None = "inst_dep_m", keys: tuple[str, ...] = KEYS, floor_m: float = 0.5, jump_m: float = 1.0, sensor_times: float = 3.0
) -> DataFrame:
    """depth_bad: over max(floor_m, 6 MAD) from the 31-row rolling median, a one-ping spike of more than jump_m, or above sensor_times the sensor depth."""
    w = along(keys)
    df = pings.withColumn("_med", rolling_median(F.col(depth), w)).withColumn("_res", F.abs(F.col(depth) - F.col("_med")))
    mid = df.groupBy(*keys).agg(F.percentile(F.col(depth) - F.col("_med"), F.lit(0.5)).alias("_mid"))
    df = df.join(mid, list(keys), "left").withColumn("_dev", F.abs(F.col(depth) - F.col("_med") - F.col("_mid")))
    mad = df.groupBy(*keys).agg(F.percentile("_dev", F.lit(0.5)).alias("_mad"))
    df = df.join(mad, list(keys), "left")
    before, after = F.col(depth) - F.lag(depth).over(w), F.col(depth) - F.lead(depth).over(w)
    spike = (F.abs(before) > jump_m) & (F.abs(after) > jump_m) & (F.signum(before) == F.signum(after))
    bad = F.coalesce(F.col("_res") > F.greatest(F.lit(floor_m), 6 * F.col("_mad")), F.lit(False)) | F.coalesce(spike, F.lit(False))
    if sensor:
        bad = bad | F.coalesce((F.col(sensor) > 0) & (F.col(depth) > sensor_times * F.col(sensor)), F.lit(False))
    return df.withColumn("depth_bad", bad).drop("_med", "_res", "_mid", "_dev", "_mad")


def without_jumps(pings: DataFrame, depth: str = "dep_m", floor: float = 1.0, keys: tuple[str, ...] = KEYS, spikes: bool = True) -> DataFrame:
    """depth with spikes and the later sides of jumps (kernels.drop_jumps) removed until none is left; the fixpoint needs a beam's depths in one task, and only these."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = kernels.drop_jumps(part["_d"].to_numpy(float), floor, spikes)
        return part.assign(_kept=np.isfinite(v))

    kind = pings.schema[depth].dataType
    lean = pings.withColumn("_d", F.col(depth).cast("double"))
    got = by_kernel(lean, keys, "record_num", ("record_num", "_d"), {"_kept": "boolean"}, run)
    return got.withColumn(depth, F.when(F.col("_kept"), F.col(depth)).cast(kind)).select(*pings.columns)


def smooth(pings: DataFrame, depth: str, out: str, window: int = 51, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Cubic Savitzky-Golay smoothing; beams shorter than the window stay as they are. Only a beam's depths meet in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = part[depth].to_numpy(float)
        return part.assign(**{out: kernels.savgol(v, window) if len(v) >= window else v})

    return by_kernel(pings, keys, "record_num", ("record_num", depth), {out: "double"}, run)


def sides_agree(pings: DataFrame, most: float = 5.0, depth: str = "dep_m") -> DataFrame:
    """Port and starboard depth by (rec_id, record_num): both nulled where they differ by more than `most`; dep_mean is their mean."""
    side = lambda s: F.max(F.when(F.col("beam").startswith(s), F.col(depth)))
    both = pings.groupBy("rec_id", "record_num").agg(side("ss_port").alias("port"), side("ss_star").alias("star"))
    apart = F.coalesce(F.abs(F.col("port") - F.col("star")) > most, F.lit(False))
    df = both.withColumn("apart", apart).withColumns({c: F.when(~F.col("apart"), F.col(c)) for c in ("port", "star")})
    return df.withColumn("dep_mean", F.when(F.col("port").isNull(), F.col("star")).when(F.col("star").isNull(), F.col("port")).otherwise((F.col("port") + F.col("star")) / 2))


def apart(pings: DataFrame, depth: str = "dep_m", sensor: str = "inst_dep_m", most: float = 5.0) -> DataFrame:
    """Adds depth_apart: of the port and starboard ping at one place that differ by more than `most`, the one farther off.

    Farther from its own sensor depth where both have one, else from its beam's rolling median; port if both are
    equally far. Sides are those of one recording and frequency, paired by position.
    """
    d, w = F.col(depth), along(KEYS)
    side = F.when(F.col("beam").startswith("ss_port"), "p").when(F.col("beam").startswith("ss_star"), "s")
    df = pings.withColumns({"_n": F.row_number().over(w), "_key": side_key(F.col("beam")), "_side": side, "_off": F.abs(d - rolling_median(d, w))})
    known = F.when((d > 0) & ~F.isnan(d), F.struct(d.cast("double").alias("d"), F.when(F.col(sensor) > 0, F.abs(d - F.col(sensor))).alias("err"), F.col("_off").alias("off")))
    at = Window.partitionBy("rec_id", "_key", "_n")
    of = lambda s: F.max(F.when(F.col("_side") == s, known)).over(at)
    df = df.withColumns({"_p": of("p"), "_s": of("s")})
    by_sensor = F.col("_p.err").isNotNull() & F.col("_s.err").isNotNull()
    port = F.when(by_sensor, F.col("_p.err") >= F.col("_s.err")).otherwise(F.col("_p.off") >= F.col("_s.off"))
    far = F.abs(F.col("_p.d") - F.col("_s.d")) > most
    bad = far & F.when(F.col("_side") == "p", port).when(F.col("_side") == "s", ~port)
    return df.withColumn("depth_apart", F.coalesce(bad, F.lit(False))).drop("_n", "_key", "_side", "_off", "_p", "_s")


def clean(pings: DataFrame, depth: str = "dep_m", sensor: str | None = "inst_dep_m", adjust_pixels: float = 0.0, smoothed: bool = True, keys: tuple[str, ...] = KEYS, jump_floor: float = 4.0, detected: bool = False) -> DataFrame:
    """Outliers, runs behind jumps of more than jump_floor and non-positive depths become null and are interpolated, then smoothed and shifted by adjust_pixels * pixM; the lineage stays in columns.

    detected: depths found in the samples, not measured; then port and starboard must agree too (apart()).
    """
    some = pings.select(*keys, "record_num", F.col(depth).cast("double").alias("_d")).where("_d > 0 AND NOT isnan(_d)")
    kept = without_jumps(some, "_d", jump_floor, keys, spikes=False).where("_d IS NULL")
    jumps = kept.select(*keys, "record_num").distinct().withColumn("_jump", F.lit(True))
    df = outliers(pings, depth, sensor, keys).withColumn(f"{depth}_raw", F.col(depth)).join(jumps, [*keys, "record_num"], "left")
    df = df.withColumn("depth_bad", F.col("depth_bad") | F.coalesce("_jump", F.lit(False))).drop("_jump")
    if detected and sensor:
        df = apart(df, depth, sensor)
        df = df.withColumn("depth_bad", F.col("depth_bad") | F.col("depth_apart")).drop("depth_apart")
    df = df.withColumn(depth, F.when(F.col("depth_bad") | (F.col(depth) <= 0), None).otherwise(F.col(depth)))
    df = fill_linear(df.withColumn(f"{depth}_interp", F.col(depth).isNull().cast("tinyint")), depth, keys, "record_num", "_f").drop(depth).withColumnRenamed("_f", depth)
    if smoothed:
        df = smooth(df, depth, "_s", keys=keys).drop(depth).withColumnRenamed("_s", depth)
    by = F.concat(F.format_string("%s", F.lit(str(adjust_pixels))), F.lit(" pixels"))
    return df.withColumn(depth, F.col(depth) + adjust_pixels * F.col("pixM")).withColumn(f"{depth}_adjBy", by).withColumn(f"{depth}_smth", F.lit(smoothed))


def series(depth: str = "dep_m", sensor: str = "inst_dep_m") -> Column:
    return F.coalesce(F.col(depth), F.col(sensor), F.lit(0.0))


def pixels(depth: Column, pix_m: Column) -> Column:
    return F.try_divide(depth, pix_m)


def sync(track: DataFrame, depths: DataFrame, columns: list[str], order: str = "file_row") -> DataFrame:
    """Depth columns of a trackline overwritten by record number; of duplicates the last counts."""
    last = depths.groupBy(*KEYS, "record_num").agg(*(F.max_by(c, order).alias(f"_{c}") for c in columns), F.lit(True).alias("_have"))
    df = track.join(last, [*KEYS, "record_num"], "left")
    return df.withColumns({c: F.when(F.col("_have"), F.col(f"_{c}")).otherwise(F.col(c) if c in track.columns else F.lit(None)) for c in columns}).drop("_have", *(f"_{c}" for c in columns))


def find_bed(labels: Column) -> Column:
    """Bed rows of a merged scan (port reversed, then starboard): distance from the centre to the first nonzero label, per side."""
    half = F.floor(F.size(labels) / 2).cast("int")
    first = lambda a: F.array_position(F.transform(a, lambda x: x != 0), True) - 1
    port, star = F.reverse(F.slice(labels, 1, half)), F.slice(labels, half + 1, F.size(labels) - half)
    return F.struct(first(port).alias("port"), first(star).alias("star"))


def detect(chunks: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id"), model: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, reach: int = 20) -> DataFrame:
    """(*keys, record_num, bed): bed rows of each chunk from (record_num, samples, bed) rows, by thresholds or an injected model(image, around)."""
    kind = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in (*keys, "record_num")) + ", bed int"
    pick = model or (lambda image, around: kernels.bed_rows(image, around, reach))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("record_num")
        n = max(map(len, part["samples"]))
        image = np.stack([np.pad(np.asarray(s, float), (0, n - len(s))) for s in part["samples"]], 1)
        out = part[[*keys, "record_num"]].copy()
        out["bed"] = np.asarray(pick(image, part["bed"].to_numpy()), np.int32)
        return out

    return chunks.select(*keys, "record_num", "samples", "bed").groupBy(*keys).applyInPandas(run, kind)


def down_beam(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Depth of a down-looking beam: the sensor's where positive, else that of the metadata, gaps interpolated."""
    df = pings.withColumn("_d", F.when(F.col("inst_dep_m") > 0, F.col("inst_dep_m")).otherwise(F.col("dep_m")))
    return fill_linear(df, "_d", keys, "record_num", "dep_final", F.col("_d") > 0).drop("_d")
