"""Empirical gain normalisation: statistics in two phases (chunk, then recording), correction, stretch, tone.

Chunk numbers and gains belong to a recording, so every key starts with rec_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stored import written
from ..functions.windows import KEYS


#: Tables of means up to this size are sent to every task; larger ones are joined.
BROADCAST_BYTES = 64 << 20


def _with(df: DataFrame, told: DataFrame, keys: list[str], how: str = "inner", most_bytes: int | None = None) -> DataFrame:
    """df joined with what is told of a few keys (a row each, written first), which goes to every task if it is at most most_bytes.

    Dealt by its keys, a survey of few recordings and beams would come together in as many tasks. A larger table has many keys.
    """
    most = BROADCAST_BYTES if most_bytes is None else most_bytes
    table = written(told, "told")
    size = 64 * len(told.columns) * table.count()  # a hashed row of so many columns takes less
    return df.join(F.broadcast(table) if size <= most else table, keys, how)


def chunk_means(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id", "row"), value: str = "v") -> DataFrame:
    """Mean of a range row within a chunk; 0 counts as missing."""
    return pixels.groupBy(*keys).agg(F.avg(F.when(F.col(value) != 0, F.col(value))).alias("chunk_mean"))


def global_means(means: DataFrame, keys: tuple[str, ...] = (*KEYS, "row")) -> DataFrame:
    """Unweighted mean of chunk means."""
    return means.groupBy(*keys).agg(F.avg("chunk_mean").alias("row_mean"))


def without_last_chunk(pixels: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    last = pixels.groupBy(*keys).agg(F.max("chunk_id").alias("_last"))
    return _with(pixels, last, list(keys)).where("chunk_id < _last").drop("_last")


def correct(pixels: DataFrame, means: DataFrame, keys: tuple[str, ...] = KEYS, value: str = "v", at: Column | None = None) -> DataFrame:
    """egn: value over the mean of its row (`at` for another row number); rows beyond the means take the last one."""
    means = written(means, "means")
    last = means.groupBy(*keys).agg(F.max("row").alias("_last"))
    df = _with(pixels, last, list(keys)).withColumn("_row", F.least(at if at is not None else F.col("row"), F.col("_last")))
    m = means.select(*keys, F.col("row").alias("_row"), "row_mean")
    return _with(df, m, [*keys, "_row"], "left").withColumn("egn", F.try_divide(F.col(value), F.col("row_mean"))).drop("_last", "_row")


def slant_row(row: Column, depth_row: Column) -> Column:
    """The ground-range row whose mean corrects a slant-range row; null in the water column."""
    return F.when(row >= depth_row, F.bround(F.sqrt((row * row - depth_row * depth_row).cast("double"))).cast("int"))


def min_max(corrected: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    return corrected.groupBy(*keys).agg(F.min("egn").alias("lo"), F.max("egn").alias("hi"))


def fold_min_max(stats: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """lo, hi of a recording, over its beams and chunks."""
    return stats.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def with_extremes(corrected: DataFrame, extremes: DataFrame, keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """corrected with the lo and hi of its recording."""
    return _with(corrected, extremes, list(keys))


def rescale(v: Column, lo: Column, hi: Column) -> Column:
    """lo..hi to 0..255, cut off; 0 where lo and hi are equal."""
    return F.least(F.greatest(F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0)) * 255, F.lit(0.0)), F.lit(255.0))


def histogram(pixels: DataFrame, keys: tuple[str, ...] = ("beam",), value: str = "v") -> DataFrame:
    """Counts in 255 bins of one unit over 0..255; the last bin is closed."""
    return pixels.where(F.col(value).between(0, 255)).groupBy(*keys, F.least(F.floor(value), F.lit(254)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def stretch_min_max(hist: DataFrame) -> DataFrame:
    """lo, hi: first and last filled bin of a histogram summed over beams, one less than its number from 1 each."""
    one = hist.groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0 AND bin > 0")
    return one.agg(F.min(F.col("bin") - 1).alias("lo"), F.max(F.col("bin") - 1).alias("hi"))


def stretch_percent(hist: DataFrame, percent: float) -> DataFrame:
    """lo, hi: the bins reached from either end while the running share stays under percent / 100; bin 0 is left out. At most 255 rows meet in one task."""
    one = hist.groupBy("bin").agg(F.sum("n").alias("n")).where("bin > 0")
    share = one.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy()))
    up, down = Window.orderBy("bin"), Window.orderBy(F.desc("bin"))
    run = share.withColumn("a", F.sum("s").over(up)).withColumn("b", F.sum("s").over(down))
    cut = percent / 100
    return run.agg(F.coalesce(F.max(F.when(F.col("a") < cut, F.col("bin"))), F.min("bin")).alias("lo"), F.coalesce(F.min(F.when(F.col("b") < cut, F.col("bin"))), F.max("bin")).alias("hi"))


def stretch(v: Column, lo: Column, hi: Column) -> Column:
    """lo..hi to 0..255, cut off; 0 stays 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.try_divide(F.least(F.greatest(v, lo), hi) - lo, hi - lo) * 255)


def tone(v: Column, gamma: float = 1.0, gain: float = 1.0) -> Column:
    return 255 * F.least(F.greatest(F.pow(v / 255, F.lit(gamma)) * gain, F.lit(0.0)), F.lit(1.0))


def chunk_range(pings: DataFrame) -> DataFrame:
    """Median range of each chunk in metres."""
    return pings.groupBy("rec_id", "beam", "chunk_id").agg(F.percentile(F.col("ping_cnt") * F.col("pixM"), F.lit(0.5)).alias("range_m"))


def range_reference(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("rec_id", "beam").agg(F.percentile("range_m", F.lit(0.5)).alias("ref_m"))


def row_statistics(pings: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """(*keys, row, chunk_mean, lo, hi) of the samples from row `bed` on; 0 counts as missing in the mean. One scan; samples are added up before any shuffle."""
    long = pings.select(*keys, "bed", F.posexplode("samples").alias("row", "v")).where("row >= bed")
    return long.groupBy(*keys, "row").agg(F.avg(F.when(F.col("v") != 0, F.col("v"))).alias("chunk_mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def gains(stats: DataFrame, keys: tuple[str, ...] = KEYS, recording: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """(*keys, means, lo, hi): the mean of each range row as one array per beam, and the recording's extremes of the corrected samples.

    Means leave out a beam's last chunk, extremes do not; a beam of one chunk has no means. Rows without
    a mean are null, rows beyond the array take its last. Dividing by a row's mean keeps order or turns
    it round, so a row's extremes give those of its corrected samples: no second scan.
    """
    last = stats.groupBy(*keys).agg(F.max("chunk_id").alias("_last"))
    known = _with(stats, last, list(keys)).where("chunk_id < _last").groupBy(*keys, "row").agg(F.avg("chunk_mean").alias("row_mean"))
    held = known.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "row_mean"))).alias("_m"))  # as long as a ping at most
    place = F.array_position(F.transform("_m", lambda m: m["row"]), F.col("_row"))
    grid = held.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.element_at("_m", -1)["row"])).alias("_row"))
    full = grid.select(*keys, "_row", F.when(place > 0, F.element_at("_m", place.cast("int"))["row_mean"]).alias("_mean"))
    arrays = full.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_row", "_mean"))), lambda m: m["_mean"]).alias("means"))
    ends = stats.join(arrays, list(keys)).withColumn("_mean", F.element_at("means", F.least(F.col("row") + 1, F.size("means"))))
    a, b = F.try_divide("lo", "_mean"), F.try_divide("hi", "_mean")
    extremes = ends.groupBy(*recording).agg(F.min(F.least(a, b)).alias("lo"), F.max(F.greatest(a, b)).alias("hi"))
    return arrays.join(extremes, list(recording))


def correct_arrays(pings: DataFrame, gains: DataFrame, gamma: float = 1.0, gain: float = 1.0, keys: tuple[str, ...] = KEYS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pings with egn and out: the samples over their rows' means, and these rescaled by the recording's extremes and toned; null above row `bed`.

    A second scan. The means, a beam's array each, go to every task if they are at most most_bytes; else both sides are joined by beam.
    """
    table = written(gains, "gains")
    size = table.agg(F.sum(F.size("means") + 4)).first()[0] or 0
    met = pings.join(F.broadcast(table) if 8 * size <= most_bytes else table, list(keys))
    fixed = F.transform("samples", lambda v, i: F.when(i >= F.col("bed"), F.try_divide(v, F.element_at("means", F.least(i + 1, F.size("means"))))))
    toned = F.transform("egn", lambda v, i: F.when(i >= F.col("bed"), tone(rescale(v, F.col("lo"), F.col("hi")), gamma, gain)))
    return met.withColumn("egn", fixed).withColumn("out", toned).drop("means", "lo", "hi")


def returns_of(corrected: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id", "record_num", "bed")) -> DataFrame:
    """A row for each sample from row `bed` on, with its corrected values: for a sink that takes pixels."""
    long = corrected.select(*keys, F.posexplode(F.arrays_zip("samples", "egn", "out")).alias("row", "_s"))
    return long.where("row >= bed").select(*keys, "row", F.col("_s.samples").alias("v"), "_s.egn", "_s.out")
