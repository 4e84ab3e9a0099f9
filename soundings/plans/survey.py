"""The three stages of a survey as DataFrame pipelines: read, rectify, map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stored import written
from ..operators import depth, egn, filters, mosaic, samples, substrate, tracks
from ..sources.tables import load_params, mosaic_images, save_tiles


@dataclass
class Params:
    nchunk: int = 500
    coordinates: bool = True
    max_heading_deviation: float = 0
    max_heading_distance: float = 0
    min_speed: float = 0
    max_speed: float = 0
    rings: list = field(default_factory=list)
    crop_range: float = 0
    keep_short: bool = False
    adjust_depth: float = 0
    smooth_depth: bool = True
    x_offset: float = 0
    y_offset: float = 0
    pixel: float = 0.25
    gamma: float = 1.0
    gain: float = 1.0
    method: str = "max"
    #: steps that change which rows there are or where values come from, off unless asked for
    repair_pings: bool = False
    both_sides: bool = False
    depth_source: int = 0  # 0 the instrument, 1 an injected model, 2 thresholds
    heading_source: str = "course"  # or "instrument"
    rectify: str = "returns"  # or "rubber"
    fill_reach: int = 0

    @classmethod
    def from_json(cls, text: str) -> Params:
        """Known settings of a JSON object over the defaults; others are ignored."""
        given = load_params(text)
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})


def read_stage(pings: DataFrame, p: Params, intervals: DataFrame | None = None, quality: dict | None = None, bed_model: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Filtered pings with transects, chunks and cleaned depths, for all recordings at once.

    In order: missing pings filled in (repair_pings), a lone side doubled (both_sides), the range cropped,
    filters, short transects, chunks, depths. Of the side-scan beams of one frequency the longest
    is filtered and the other one takes its rows by position. Depths come from the instrument, or
    from samples (depth_source); other beams take the sensor's, else that of the metadata.
    """
    df = pings
    if p.repair_pings:
        had = df.select("rec_id", "beam").distinct()
        names = [r["beam"] for r in had.select("beam").distinct().collect()]  # names of beams, a handful
        df = tracks.missing_pings(df, names).drop("cycle").join(had, ["rec_id", "beam"], "left_semi")
    if p.both_sides:
        df = tracks.beam_duplicate(df)
    df = tracks.crop_range(df, p.crop_range)
    df = df.withColumn("index", F.row_number().over(Window.partitionBy("rec_id", "beam").orderBy("record_num")).cast("long"))
    df = df.withColumn("_key", tracks.side_key(F.col("beam")))
    rows = df.where("_key IS NOT NULL").groupBy("rec_id", "_key", "beam").agg(F.count("*").alias("k"))
    lead = rows.groupBy("rec_id", "_key").agg(F.min_by("beam", F.struct(-F.col("k"), F.col("beam"))).alias("_lead"))
    df = df.join(lead, ["rec_id", "_key"], "left")
    own, partner = df.where("_lead IS NULL OR beam = _lead").drop("_lead"), df.where("beam <> _lead").drop("_lead")
    kept = filters.apply(own, p.max_heading_deviation, p.max_heading_distance, p.min_speed, p.max_speed, p.rings, intervals, quality, p.coordinates).where("filter")
    if not p.keep_short:
        kept = filters.short_transects(kept, p.nchunk).where("filter")
    kept = tracks.transects(kept, p.nchunk)
    flags = kept.where("_key IS NOT NULL").select("rec_id", "_key", "index", "filter", "transect", "chunk_id")
    follow = partner.join(flags, ["rec_id", "_key", "index"])
    df = written(kept.unionByName(follow, allowMissingColumns=True), "kept-pings")  # the depth steps read it several times

    side = F.col("_key").isNotNull()
    if p.depth_source:
        bed = df.where(side).withColumn("bed", samples.bed_row(F.coalesce(F.when(F.col("inst_dep_m") > 0, F.col("inst_dep_m")), "dep_m"), F.col("pixM")))
        found = depth.detect(bed, model=bed_model if p.depth_source == 1 else None).withColumnRenamed("bed", "_bed")
        df = df.join(found, ["rec_id", "beam", "chunk_id", "record_num"], "left")
        df = df.withColumn("dep_m", F.when(F.col("_bed").isNotNull(), F.col("_bed") * F.col("pixM")).otherwise(F.col("dep_m"))).drop("_bed")
    cleaned = depth.clean(df.where(side), adjust_pixels=p.adjust_depth, smoothed=p.smooth_depth, detected=p.depth_source > 0)
    down = depth.down_beam(df.where(~side))
    down = down.withColumn("dep_m_raw", F.col("dep_m")).withColumn("dep_m", F.col("dep_final")).drop("dep_final")
    return cleaned.unionByName(down, allowMissingColumns=True).drop("_key")


def shadow_stage(pings: DataFrame, model: Callable[[np.ndarray], np.ndarray], holes: int = 100, objects: int = 100, far_only: bool = False) -> DataFrame:
    """Pings with `shadows`, the spans of rows that an injected two-class model marks, without small holes and small regions; null where it marks none."""
    mask = substrate.predict(pings, model).select("rec_id", "beam", "chunk_id", "row", "col", (substrate.argmax(F.col("logits")) == 2).alias("mask"))
    mask = substrate.clean_mask(mask, holes=holes, objects=objects)
    place = F.row_number().over(Window.partitionBy("rec_id", "beam", "chunk_id").orderBy("record_num")) - 1
    at = pings.select("rec_id", "beam", "chunk_id", "record_num", place.alias("col"))
    spans = substrate.shadow_spans(mask.join(at, ["rec_id", "beam", "chunk_id", "col"]), far_only=far_only)
    return pings.join(spans.withColumnRenamed("spans", "shadows"), ["rec_id", "beam", "record_num"], "left")


def gain_arrays(pings: DataFrame, p: Params) -> DataFrame:
    """Pings with bed, and with egn and out beside their samples: corrected by the recording's row means, rescaled by its extremes and toned.

    Two scans of the pings: one for the statistics, one for the output; samples stay in their ping's arrays.
    """
    bed = pings.withColumn("bed", samples.bed_row(F.col("dep_m"), F.col("pixM")))
    return egn.correct_arrays(bed, egn.gains(written(egn.row_statistics(bed), "row-statistics")), p.gamma, p.gain)


def gain_stage(pings: DataFrame, p: Params) -> DataFrame:
    """gain_arrays() as pixels: rec_id, beam, chunk_id, record_num, bed, row, v, egn, out."""
    return egn.returns_of(gain_arrays(pings, p))


def rectify_stage(pings: DataFrame, p: Params) -> DataFrame:
    """Pings with smoothed course, offset position and range edge, in degrees and in metres of the recording's UTM zone.

    A spline per transect, the seams of chunks patched, bearings and offset from it, then range edges linear
    between every tenth of a chunk's pings, leaving out those whose lines overlap (overlap).
    """
    every = max(p.nchunk // 10, 1)
    course = tracks.smooth(pings, every, x="lon", y="lat")
    smoothed = {c: F.coalesce(F.when(~F.isnan(s), F.col(s)), F.col(c)) for c, s in (("lon", "x_s"), ("lat", "y_s"))}
    df = course.withColumns(smoothed).drop("x_s", "y_s")
    if p.heading_source == "instrument":
        df = tracks.smooth_heading(df).withColumnRenamed("heading_s", "cog")
    else:
        df = tracks.bearings(df)
    df = tracks.patch_seams(df, ("lon", "lat", "cog"))
    if p.x_offset or p.y_offset:
        df = tracks.offset(df, p.x_offset, p.y_offset)
    df = tracks.range_edges(df, sane=filters.sane_chunk(df))
    zone = pings.groupBy("rec_id").agg(geo.utm_zone(F.avg("lon")).alias("_zone"))
    metres = lambda d, c: d.withColumns(dict(zip((f"{c}e", f"{c}n"), geo.utm(F.col(f"{c}lon"), F.col(f"{c}lat"), F.col("_zone")))))
    df = tracks.overlaps(metres(metres(df.join(zone, "rec_id"), ""), "range_"), every=every)
    df = tracks.relinearise(df, every, columns=("range_lon", "range_lat"))
    return metres(df, "range_").drop("_zone")


def mosaic_stage(pings: DataFrame, p: Params, how: str = "last") -> DataFrame:
    """One value per map pixel of all recordings, later chunks over earlier ones, on a grid of p.pixel metres.

    A recording's grid is that of the UTM zone of its mean longitude (column zone, for its code); recordings in one
    zone share a map. Pixels are the means of their samples, or with rectify "rubber" each
    chunk is warped between its track and its range edge. fill_reach closes a chunk's gaps.
    """
    if p.rectify == "rubber":
        zone = pings.groupBy("rec_id").agg(geo.utm_zone(F.avg("lon")).alias("zone"))
        tiles = mosaic.rubber_sheet(pings, p.pixel).join(zone, "rec_id")
    else:
        points = mosaic.returns(pings.select("rec_id", "beam", "chunk_id", "record_num", "lon", "lat", "ping_bearing", "pixM", "samples"))
        zone = pings.groupBy("rec_id").agg(geo.utm_zone(F.avg("lon")).alias("zone"))
        x, y = geo.utm(F.col("x"), F.col("y"), F.col("zone"))
        cells = mosaic.to_cells(points.join(zone, "rec_id").withColumns({"x": x, "y": y}), p.pixel)
        tiles = mosaic.raster_mean(cells, ("rec_id", "beam", "chunk_id", "zone", "gx", "gy"))
    if p.fill_reach:
        tiles = mosaic.interpolate_gaps(tiles, ("rec_id", "beam", "chunk_id", "zone"), p.fill_reach)
    return mosaic.merge(tiles, how, F.struct("rec_id", "chunk_id", "beam"), keys=("zone", "gx", "gy"))


def save_mosaic(pixels: DataFrame, path: str, p: Params, south: bool = False) -> None:
    """GeoTIFF tiles of a mosaic as a table (zone, tx, ty, tiff) at path, each zone in its own projection."""
    zones = [r["zone"] for r in pixels.select("zone").distinct().collect()]  # at most 60
    bytes_ = pixels.withColumn("v", F.bround("v").cast("int"))
    made = [mosaic_images(bytes_.where(F.col("zone") == z), (32700 if south else 32600) + int(z), p.pixel).withColumn("zone", F.lit(z)) for z in zones]
    if made:
        save_tiles(reduce(DataFrame.unionByName, made), path)


def map_stage(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray], p: Params, least: int = 0) -> DataFrame:
    """Class per pixel by an injected model, run on overlapping windows over each chunk and its neighbours; small regions given to their neighbours."""
    got = substrate.classify(substrate.predict_windows(chunks, model, p.nchunk), p.method)
    return substrate.sieve(got, least) if least else got


def run(pings: DataFrame, p: Params | None = None) -> dict[str, DataFrame]:
    """All stages: pings, track, gain-corrected pixels and mosaic."""
    p = p or Params()
    read = read_stage(pings, p)
    track = rectify_stage(read, p)
    out = {"pings": read, "track": track}
    if "samples" in pings.columns:
        out |= {"gain": gain_stage(read, p), "mosaic": mosaic_stage(track, p)}
    return out


def batch(recordings: DataFrame, pings: DataFrame, p: Params | None = None) -> DataFrame:
    """rec_id, status, n_pings, n_kept, n_chunks of each recording: one job for all, whatever their number.

    Rows that a reader marked with an error count as no pings; their recordings are "damaged",
    even where some pings could be read, and the others go on.
    """
    faults = None
    if "error" in pings.columns:
        faults = pings.where("error IS NOT NULL").groupBy("rec_id").agg(F.min("error").alias("error"))
        pings = pings.where("error IS NULL").drop("error")
    kept = read_stage(pings, p or Params()).groupBy("rec_id").agg(F.count("*").alias("n_kept"), F.countDistinct("beam", "chunk_id").alias("n_chunks"))
    seen = pings.groupBy("rec_id").agg(F.count("*").alias("n_pings"))
    df = recordings.select("rec_id").join(seen, "rec_id", "left").join(kept, "rec_id", "left")
    df = df.join(faults, "rec_id", "left") if faults is not None else df.withColumn("error", F.lit(None).cast("string"))
    status = F.when(F.col("error").isNotNull(), "damaged").when(F.col("n_pings").isNull(), "no pings").when(F.col("n_kept").isNull(), "all filtered").otherwise("done")
    return df.select("rec_id", status.alias("status"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_pings", "n_kept", "n_chunks")), "error")
