"""Ping quality filters. Each adds or narrows a boolean column; none drops rows. Null measurements are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.quantiles import percentiles
from ..functions.windows import KEYS, along, as_of, island_lengths, unwrap


def _and(df: DataFrame, keep: Column, flag: str) -> DataFrame:
    return df.withColumn(flag, (F.col(flag) & keep) if flag in df.columns else keep)


def coordinate_outliers(pings: DataFrame, scale: float = 3.0, keys: tuple[str, ...] = KEYS, flag: str = "filter") -> DataFrame:
    """False for positions outside Q1 - scale * IQR .. Q3 + scale * IQR of their beam, in lon or lat."""
    fence = percentiles(pings, "lon", (0.25, 0.75), keys, "_qx", fused=True).join(percentiles(pings, "lat", (0.25, 0.75), keys, "_qy", fused=True), list(keys))
    out = F.lit(False)
    for c, b in (("lon", "_qx"), ("lat", "_qy")):
        lo, hi = F.col(b)[0], F.col(b)[1]
        out = out | F.coalesce((F.col(c) < lo - scale * (hi - lo)) | (F.col(c) > hi + scale * (hi - lo)), F.lit(False))
    return _and(pings.join(fence, list(keys), "left"), ~out, flag).drop("_qx", "_qy")


def speed(pings: DataFrame, least: float = 0, most: float = 0, flag: str = "filter") -> DataFrame:
    """False below `least` or above `most` (0: no bound)."""
    bad = F.lit(False)
    if least > 0:
        bad = bad | F.coalesce(F.col("speed_ms") < least, F.lit(False))
    if most > 0:
        bad = bad | F.coalesce(F.col("speed_ms") > most, F.lit(False))
    return _and(pings, ~bad, flag)


def heading(pings: DataFrame, deviation: float, distance: float, keys: tuple[str, ...] = KEYS, flag: str = "filter") -> DataFrame:
    """True where the heading turns less than `deviation` degrees within its window of `distance` metres.

    Windows are [k d, (k + 1) d) of trk_dist, the last closed. A window with one heading fails;
    with under two headings in all, or a track no longer than d, there is one window, and
    too few headings pass. Both ends of a jump of more than d metres fail.
    """
    if distance <= 0:
        raise ValueError("distance must be positive")
    whole = Window.partitionBy(*keys)
    df = pings.withColumn("_far", F.max("trk_dist").over(whole))
    last = F.greatest(F.ceil(F.col("_far") / distance) - 1, F.lit(0))
    df = df.withColumn("_b", F.when(F.col("_far") <= distance, 0).otherwise(F.least(F.floor(F.col("trk_dist") / distance), last)))
    df = unwrap(df, "instr_heading", along((*keys, "_b")), "_u")
    bin_ = Window.partitionBy(*keys, "_b")
    few = F.count("instr_heading").over(whole) < 2
    keep = few | ((F.max("_u").over(bin_) - F.min("_u").over(bin_) < deviation) & (F.count("_u").over(bin_) > 1))
    w = along(keys)
    jump = (F.col("trk_dist") - F.lag("trk_dist").over(w) > distance) | (F.lead("trk_dist").over(w) - F.col("trk_dist") > distance)
    df = df.withColumn("_k", F.coalesce(keep, F.lit(False)) & ~F.coalesce(jump, F.lit(False)))
    return _and(df, F.col("_k"), flag).drop("_far", "_b", "_u", "_k")


def time_intervals(pings: DataFrame, intervals: DataFrame, flag: str = "filter_time", relative: bool | None = None) -> DataFrame:
    """True inside any [start_seconds, end_seconds] (ends swapped if reversed, both included).

    `relative` says whether intervals count from the earliest ping. Left open, it is guessed from the
    times: epoch pings (earliest above 1e8) with intervals below 1e7 take them so, longer surveys do not. Each interval's start carries the largest end of all that start no
    later; a ping is inside if the last start before it carries an end it has not passed. So
    pings are read once, in one stream with the starts; only the intervals, two numbers each,
    are put in order in one task.
    """
    span = pings.agg(F.min("time_s").alias("lo")).first()
    pair = F.least("start_seconds", "end_seconds").alias("a"), F.greatest("start_seconds", "end_seconds").alias("b")
    iv = intervals.where("start_seconds IS NOT NULL AND end_seconds IS NOT NULL").select(*pair)
    top = iv.agg(F.max(F.greatest(F.abs("a"), F.abs("b"))).alias("m")).first()["m"]
    if span["lo"] is None or top is None:
        return _and(pings, F.lit(False), flag)
    if relative is None:
        relative = span["lo"] > 1e8 and top < 1e7
    shift = span["lo"] if relative else 0.0
    starts = iv.groupBy((F.col("a") + shift).cast("double").alias("_a")).agg(F.max(F.col("b") + shift).cast("double").alias("_b"))
    starts = starts.select("_a", F.max("_b").over(Window.orderBy("_a")).alias("_b"))
    out = as_of(pings.withColumn("_t", F.col("time_s").cast("double")), starts, "_t", "_a", "_b", "_until")
    return _and(out, F.coalesce(F.col("_until") >= F.col("_t"), F.lit(False)), flag).drop("_t", "_until")


def area(pings: DataFrame, rings: list[list[tuple[float, float]]], x: str = "e", y: str = "n", buffer: float = 0.0, flag: str = "filter") -> DataFrame:
    """True strictly inside any ring (a list of (x, y)), or within `buffer` of one. Rings are a parameter, so small by nature."""
    inside = F.lit(False)
    for ring in rings:
        r = F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring))
        hit, away = geo.in_ring(F.col(x), F.col(y), r), geo.ring_distance(F.col(x), F.col(y), r)
        inside = inside | (hit | (away < buffer) if buffer > 0 else hit & (away > 1e-9))
    return _and(pings, F.coalesce(inside, F.lit(False)), flag)


def plan_rings(plans: DataFrame, column: str = "value") -> DataFrame:
    """(item, ring) of mission plan JSON: mission.items[].polygon[] = [lat, lon], turned into x = lon, y = lat."""
    kind = T.StructType([T.StructField("mission", T.StructType([T.StructField("items", T.ArrayType(T.StructType([T.StructField("polygon", T.ArrayType(T.ArrayType(T.DoubleType())))])))]))])
    items = plans.select(F.posexplode(F.from_json(column, kind)["mission"]["items"]).alias("item", "i")).where("i.polygon IS NOT NULL")
    return items.select("item", F.transform("i.polygon", lambda p: F.struct(p[1].alias("x"), p[0].alias("y"))).alias("ring"))


def keep_values(values: str | list | None) -> list[str]:
    """Kept flags, trimmed and lower-cased; an empty list is an error."""
    parts = values.split(",") if isinstance(values, str) else list(values or [])
    out = sorted({str(v).strip().lower() for v in parts} - {""})
    if not out:
        raise ValueError("dq_keep_values must name at least one value")
    return out


def _offset(value: object, name: str) -> float | None:
    if value is None or value is False or value == "":
        return None
    try:
        return float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise ValueError(f"{name} must be a number of hours") from None


ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def wall_time(text: Column) -> Column:
    """A timestamp without zone from text; a zone is dropped and the wall time kept; fractions and slashes are allowed."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), ZONE, ""), "/", "-")
    return plain.try_cast("timestamp_ntz")


def quality_state(
    pings: DataFrame, log: DataFrame, time_field: str | None, flag_field: str | None, keep: str | list | None, source_offset: object = None, target_offset: object = None,
    shift_seconds: float = 0.0, by: tuple[str, ...] = (), flag: str = "filter_dq",
) -> DataFrame:
    """True while the latest log event at or before a ping has a kept flag; false before the first event.

    Times are numbers when every log time is one, else wall times. Of events at one time the
    last in the log (column file_row, if there) counts. Offsets are hours: both or neither.
    """
    if not time_field:
        raise ValueError("dq_time_field is required")
    if not flag_field:
        raise ValueError("dq_flag_field is required")
    for c in (time_field, flag_field):
        if c not in log.columns:
            raise ValueError(f"the quality log has no column {c}")
    kept = keep_values(keep)
    src, dst = _offset(source_offset, "dq_src_utc_offset"), _offset(target_offset, "dq_target_utc_offset")
    if (src is None) != (dst is None):
        raise ValueError("set both UTC offsets or neither")
    row = F.col("file_row") if "file_row" in log.columns else F.monotonically_increasing_id()
    text = F.col(time_field).cast("string")
    told = log.select(F.lower(F.trim(F.coalesce(F.col(flag_field).cast("string"), F.lit("")))).isin(kept).alias("_keep"), text.try_cast("double").alias("_num"), wall_time(text).alias("_wall"), text.alias("_text"), row.alias("_row_no"), *by)
    kinds = told.where("_text IS NOT NULL").agg(F.count("*").alias("n"), F.count("_num").alias("num"), F.count("_wall").alias("wall")).first()
    numeric = kinds["num"] == kinds["n"]
    clock = [c for c in ("date", "time") if c in pings.columns]
    if numeric:
        if "time_s" not in pings.columns:
            raise ValueError("the quality log has numeric times but the pings have no time_s")
        own, ev = F.col("time_s").cast("double"), F.col("_num") + shift_seconds
    else:
        if not clock:
            raise ValueError("timestamp types differ: the quality log has wall times but the pings have numbers")
        hours = (dst or 0.0) - (src or 0.0)
        own = wall_time(F.concat_ws(" ", *clock))
        # wall times are compared as seconds, so shifts are plain sums
        seconds = lambda t: F.unix_micros(t.cast("timestamp")) / 1e6
        own, ev = seconds(own), seconds(F.col("_wall")) + hours * 3600 + shift_seconds
    events = told.withColumn("_at", ev).where("_at IS NOT NULL")
    out = as_of(pings.withColumn("_own", own), events, "_own", "_at", "_keep", "_state", by, "_row_no").drop("_own")
    return _and(out, F.coalesce("_state", F.lit(False)), flag).drop("_state")


def short_transects(pings: DataFrame, nchunk: int, index: str = "index", keys: tuple[str, ...] = KEYS, flag: str = "filter") -> DataFrame:
    """False for runs of consecutive index with fewer than nchunk rows."""
    df = island_lengths(F.col(index), Window.partitionBy(*keys).orderBy(index), keys, pings)
    return _and(df, F.col("_len") >= nchunk, flag).drop("_run", "_len")


def sane_chunk(pings: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """Rows with positive ping_cnt; of those with pixM > 1e-4 if a chunk has any, then ping_cnt < 1e6 if any; all rows of a chunk that would lose all."""
    w = Window.partitionBy(*keys)
    df = pings.withColumn("_a", F.coalesce(F.col("ping_cnt") > 0, F.lit(False)))
    df = df.withColumn("_p", F.col("_a") & F.coalesce(F.col("pixM") > 1e-4, F.lit(False))).withColumn("_b", F.when(F.max("_p").over(w), F.col("_p")).otherwise(F.col("_a")))
    df = df.withColumn("_q", F.col("_b") & (F.col("ping_cnt") < 1000000)).withColumn("_c", F.when(F.max("_q").over(w), F.col("_q")).otherwise(F.col("_b")))
    return df.withColumn("_some", F.max("_c").over(w)).where("_c OR NOT _some").drop("_a", "_p", "_b", "_q", "_c", "_some")


def spread(flags: DataFrame, others: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Copy columns from the longest beam to other beams by row position."""
    at = lambda d, k: d.withColumn("_pos", F.row_number().over(Window.partitionBy(*k).orderBy("record_num")))
    a = at(flags, keys).select(*keys, "_pos", *columns)
    return at(others.drop(*columns), KEYS).join(a, [*keys, "_pos"], "left").drop("_pos")


def apply(
    pings: DataFrame, max_heading_deviation: float = 0, max_heading_distance: float = 0, min_speed: float = 0, max_speed: float = 0, rings: list | None = None,
    intervals: DataFrame | None = None, quality: dict | None = None, coordinates: bool = True,
) -> DataFrame:
    """The filters in the order coordinates, heading, speed, area, time, quality, ANDed in column `filter`."""
    df = pings.withColumn("filter", F.lit(True)) if "filter" not in pings.columns else pings
    if coordinates:
        df = coordinate_outliers(df)
    if max_heading_deviation > 0 and max_heading_distance > 0:
        df = heading(df, max_heading_deviation, max_heading_distance)
    if min_speed > 0 or max_speed > 0:
        df = speed(df, min_speed, max_speed)
    if rings:
        df = area(df, rings, "lon", "lat")
    if intervals is not None:
        df = time_intervals(df, intervals, "filter")
    if quality:
        df = quality_state(df, flag="filter", **quality)
    return df
