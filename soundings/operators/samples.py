"""Transforms of sample arrays (samples ARRAY<DOUBLE>, first sample at the transducer)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import percentiles
from . import kernels


def bed_row(depth: Column, pix_m: Column) -> Column:
    return F.bround(depth / pix_m).cast("int")


def keep_bed(samples: Column, bed: Column) -> Column:
    """0 above the bed row (the water column)."""
    return F.transform(samples, lambda x, i: F.when(i >= bed, x).otherwise(F.lit(0.0)))


def keep_water(samples: Column, bed: Column, deepest: Column) -> Column:
    """Only the water column, cropped to the deepest bed row of the chunk."""
    return F.slice(F.transform(samples, lambda x, i: F.when(i < bed, x).otherwise(F.lit(0.0))), 1, deepest)


def crop_bed(samples: Column, bed: Column, shallowest: Column) -> Column:
    """keep_bed(), with rows above the shallowest bed row of the chunk cut off."""
    return F.slice(keep_bed(samples, bed), shallowest + 1, F.greatest(F.size(samples) - shallowest, F.lit(0)))


def mask_spans(samples: Column, spans: Column) -> Column:
    """0 inside any [a, b) of spans ARRAY<STRUCT<a, b>>."""
    return F.transform(samples, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["a"]) & (i < s["b"])), F.lit(0.0)).otherwise(x))


def slant_range(rows: DataFrame, keys: tuple[str, ...], samples: str = "samples", bed: str = "bed") -> DataFrame:
    """(*keys, i, v, filled) of samples moved to ground range: row r goes to round(sqrt(r^2 - bed^2)), the last one wins, gaps are filled linearly.

    Regrouping a ping's rows is by its own keys, so work is spread over pings.
    """
    long = rows.select(*keys, F.col(bed).alias("_d"), F.posexplode(samples).alias("_r", "_v")).where("_r >= _d")
    to = F.bround(F.sqrt((F.col("_r") * F.col("_r") - F.col("_d") * F.col("_d")).cast("double"))).cast("int")
    hit = long.groupBy(*keys, to.alias("i")).agg(F.max_by("_v", "_r").alias("v"))
    w = Window.partitionBy(*keys).orderBy("i")
    nxt = hit.withColumn("_i1", F.lead("i").over(w)).withColumn("_v1", F.lead("v").over(w))
    some = nxt.select(*keys, "v", "_v1", "_i1", F.col("i").alias("_i0"), F.explode(F.sequence("i", F.coalesce(F.col("_i1") - 1, F.col("i")))).alias("i"))
    filled = F.when(F.col("i") == F.col("_i0"), F.col("v")).otherwise(F.col("v") + (F.col("_v1") - F.col("v")) * (F.col("i") - F.col("_i0")) / (F.col("_i1") - F.col("_i0")))
    return some.select(*keys, "i", F.when(F.col("i") == F.col("_i0"), F.col("v")).alias("v"), filled.alias("filled"))


def tvg(samples: Column, k: float = 20.0, absorption: float = 0.0, cap: float = 60.0, pix_m: Column | float = 1.0) -> Column:
    """Time-varying gain: samples times 10 ** (dB / 20), dB = k log10(r) + 2 a r, between 0 and cap, r at least one pixel."""
    p = F.lit(pix_m) if isinstance(pix_m, (int, float)) else pix_m
    db = lambda i: F.least(F.greatest(k * F.log10((i + 1) * p) + 2 * absorption * (i + 1) * p, F.lit(0.0)), F.lit(cap))
    return F.transform(samples, lambda x, i: x * F.pow(F.lit(10.0), db(i) / 20))


def decibels(v: Column, chunk: Window) -> Column:
    """20 log10 of values floored at the chunk's least positive one, shifted so that it becomes 0."""
    least = F.min(F.when(v > 0, v)).over(chunk)
    return 20 * F.log10(F.greatest(v, least)) - 20 * F.log10(least)


def to_byte(v: Column, lo: Column, hi: Column) -> Column:
    """Linear scale of lo..hi to 0..255, cut off and truncated."""
    return F.greatest(F.least(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * 255, F.lit(255.0)), F.lit(0.0)).cast("int")


def narrow(v: Column, low_zero_share: Column) -> Column:
    """16-bit words to bytes: where over 95 % have a zero low byte the words shift by 8, else by 4; the rest wraps modulo 256."""
    i = v.cast("int")
    return F.when(low_zero_share > 0.95, F.shiftright(i, 8)).otherwise(F.shiftright(i, 4)).bitwiseAND(255)


def stretch_bounds(pixels: DataFrame, value: str, keys: tuple[str, ...] = (), lo: float = 0.01, hi: float = 0.995) -> DataFrame:
    """lo, hi: percentiles of the positive values, per keys."""
    q = percentiles(pixels.where(F.col(value) > 0), value, (lo, hi), keys, "_q")
    return q.select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def unit(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def to_u16(v: Column, most: Column) -> Column:
    """To 16 bits: times 257 where the image holds bytes."""
    return F.when(most <= 255, v * 257).otherwise(v).cast("int")


def reserve_zero(v: Column, preserve: bool = False) -> Column:
    """0 means no data, so a measured 0 becomes 1."""
    return v if preserve else F.when(v == 0, 1).otherwise(v)


def rescale(df: DataFrame, value: str, lo: float, hi: float, keys: tuple[str, ...], out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    a, b = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.try_divide((hi - lo) * (F.col(value) - a), b - a) + lo)


def match_median(pixels: DataFrame, value: str, chunk: tuple[str, ...], target: float, out: str) -> DataFrame:
    """value scaled so that its chunk's median of positives meets target, by a factor of 0.75 to 1.25."""
    mid = pixels.where(F.col(value) > 0).groupBy(*chunk).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    k = F.least(F.greatest(target / F.col("_m"), F.lit(0.75)), F.lit(1.25))
    return pixels.join(mid, list(chunk), "left").withColumn(out, F.col(value) * F.coalesce(k, F.lit(1.0))).drop("_m")


def sampled(pixels: DataFrame, value: str, chunk: tuple[str, ...], most: int, order: tuple[str, ...]) -> DataFrame:
    """At most `most` evenly spaced values of each chunk: a statistic's sample, by position."""
    w = Window.partitionBy(*chunk)
    df = pixels.where(F.col(value) > 0).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = F.greatest(F.ceil(F.col("_n") / most), F.lit(1))
    return df.where(F.col("_i") % step == 0).drop("_i", "_n")


def level_colors(spark, name: str = "grey", levels: int = 255) -> DataFrame:
    """level 0 .. levels - 1 with r, g, b from a rule: grey, or heat (black, red, yellow, white)."""
    t = F.col("id") / (levels - 1)
    part = lambda a: F.bround(F.least(F.greatest((t - a) * 3, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    g = F.bround(t * 255).cast("int")
    r, gr, b = (g, g, g) if name == "grey" else (part(0.0), part(1 / 3), part(2 / 3))
    return spark.range(levels).select(F.col("id").cast("int").alias("level"), r.alias("r"), gr.alias("g"), b.alias("b"))


def colorize(pixels: DataFrame, value01: Column, colors: DataFrame, levels: int = 255) -> DataFrame:
    """Pixels with the colour of their level; the table of levels is broadcast (it has `levels` rows)."""
    return pixels.withColumn("level", F.least(F.floor(value01 * (levels - 1)), F.lit(levels - 1)).cast("int")).join(F.broadcast(colors), "level", "left")


def jsf_scale(adc: Column, weight: Column) -> Column:
    """Samples in weighted units: adc * 2 ** -weight."""
    return adc * F.pow(F.lit(2.0), -weight)


def jsf_scale_max(pings: DataFrame, adc: str = "max_abs_adc_raw", weight: str = "weighting_factor") -> DataFrame:
    """scale_max: the 99.5th percentile of adc * 2 ** -w, or 65535 * 2 ** -min(w) without values."""
    return pings.agg(F.coalesce(F.percentile(jsf_scale(F.col(adc), F.col(weight)), F.lit(0.995)), 65535 * F.pow(F.lit(2.0), -F.min(weight))).alias("scale_max"))


def side_by_side(port: DataFrame, star: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Port reversed, then starboard; the shorter side is padded by its own mirror image at the far end."""
    pad = lambda a, n: F.when(F.size(a) < n, F.concat(a, F.slice(F.reverse(a), 1, n - F.size(a)))).otherwise(a)
    both = port.select(*keys, F.col("samples").alias("_p")).join(star.select(*keys, F.col("samples").alias("_s")), list(keys), "full_outer")
    n = F.greatest(F.size("_p"), F.size("_s"), F.lit(0))
    none = F.array().cast("array<double>")
    p, s = F.coalesce("_p", none), F.coalesce("_s", none)
    return both.withColumn("samples", F.concat(F.reverse(pad(p, n)), pad(s, n))).drop("_p", "_s")


def _chunk_images(pixels: DataFrame, keys: tuple[str, ...], value: str, f, kind: str = "double") -> DataFrame:
    """(*keys, row, col, value) of each chunk's image after f(image), which may change its size."""
    s = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + f", row int, col int, {value} {kind}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        image = np.zeros((r.max() + 1, c.max() + 1))
        image[r, c] = part[value]
        out = f(image, part)
        i, j = np.indices(out.shape)
        got = pd.DataFrame({"row": i.ravel().astype(np.int32), "col": j.ravel().astype(np.int32), value: out.ravel()})
        for k in keys:
            got[k] = part[k].iloc[0]
        return got

    return pixels.groupBy(*keys).applyInPandas(run, s)


def enhance(pixels: DataFrame, keys: tuple[str, ...], lo: float, hi: float, value: str = "v", tiles: int = 8, clip: float = 0.01) -> DataFrame:
    """Contrast-limited equalisation of chunk images, with survey-wide bounds lo and hi mapped to 0 and 1; values are 0..255."""
    return _chunk_images(pixels, keys, value, lambda a, _: kernels.clahe(np.clip((a - lo) / max(hi - lo, 1e-12), 0, 1), tiles, clip) * 255)


def correct_speed(pixels: DataFrame, keys: tuple[str, ...], value: str = "v", factor: float = 0.0) -> DataFrame:
    """Chunk images resized along the track: to track metres / pixM (columns trk_dist, pixM) pixels, or by `factor`."""

    def run(a: np.ndarray, part: pd.DataFrame) -> np.ndarray:
        span = float(part["trk_dist"].max() - part["trk_dist"].min()) if not factor else 0.0
        width = round(a.shape[1] * factor) if factor else round(span / float(part["pixM"].iloc[0]))
        return kernels.resize(a, (a.shape[0], max(1, int(width))))

    return _chunk_images(pixels, keys, value, run)
