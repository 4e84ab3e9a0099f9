"""Projection of samples to pixels, mosaics as merges of pixel tables, and polygons."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.windows import KEYS
from . import kernels


def returns(pings: DataFrame, lon: str = "lon", lat: str = "lat", bearing: str = "ping_bearing") -> DataFrame:
    """A row for each sample (row, v) with its position along the ping's bearing at row * pixM metres."""
    df = pings.select("*", F.posexplode("samples").alias("row", "v")).drop("samples")
    x, y = geo.destination(F.col(lon), F.col(lat), F.col(bearing), F.col("row") * F.col("pixM"))
    return df.withColumns({"x": x, "y": y})


def attach(coords: DataFrame, samples: DataFrame, keys: tuple[str, ...] = (*KEYS, "record_num")) -> DataFrame:
    """Sample values joined to coordinates by record and row; what only one side has goes."""
    return coords.join(samples.select(*keys, F.posexplode("samples").alias("row", "v")), [*keys, "row"])


def pixel_grid(points: DataFrame, keys: tuple[str, ...], width: Column, height: Column) -> DataFrame:
    """px, py: coordinates scaled to a chunk's pixel grid, top left first."""
    w = Window.partitionBy(*keys)
    span = lambda c: (F.min(c).over(w), F.max(c).over(w))
    (x0, x1), (y0, y1) = span("x"), span("y")
    return points.withColumn("px", F.bround(F.coalesce(F.try_divide(F.col("x") - x0, x1 - x0), F.lit(0.0)) * (width - 1)).cast("int")).withColumn("py", F.bround(F.coalesce(F.try_divide(y1 - F.col("y"), y1 - y0), F.lit(0.0)) * (height - 1)).cast("int"))


def to_cells(points: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """gx, gy: the cell of a grid of `size`, aligned to whole multiples of it."""
    return points.withColumn("gx", F.floor(F.col(x) / size)).withColumn("gy", F.floor(F.col(y) / size))


def raster_mean(points: DataFrame, keys: tuple[str, ...] = ("gx", "gy"), value: str = "v") -> DataFrame:
    return points.groupBy(*keys).agg(F.avg(value).alias("v"), F.count("*").alias("n"))


#: Merges of the values that tiles have at a pixel; 0 is no data. `order` ranks tiles.
MERGES: dict[str, Callable[[Column, Column], Column]] = {
    "first": lambda v, order: F.min_by(v, order),
    "last": lambda v, order: F.max_by(v, order),
    "max": lambda v, order: F.max(v),
    "average": lambda v, order: F.avg(v),
    "sum": lambda v, order: F.sum(v),
    "min": lambda v, order: F.min(v),
}


def register_merge(name: str, f: Callable[[Column, Column], Column]) -> None:
    """Add a named merge: f(value, order) -> aggregate."""
    MERGES[name] = f


def merge(tiles: DataFrame, how: str, order: Column, keys: tuple[str, ...] = ("gx", "gy"), value: str = "v", limits: tuple[float, float] | None = (0, 255)) -> DataFrame:
    """One value per pixel of overlapping tiles, cut off to limits."""
    got = tiles.where(F.col(value) != 0).groupBy(*keys).agg(MERGES[how](F.col(value), order).alias("v"))
    return got.withColumn("v", F.least(F.greatest(F.col("v"), F.lit(limits[0])), F.lit(limits[1]))) if limits else got


def merge_class(layers: DataFrame, keys: tuple[str, ...] = ("gx", "gy"), layer: str = "layer", value: str = "v") -> DataFrame:
    """The layer with the largest value; the smallest such layer on ties."""
    return layers.groupBy(*keys).agg(F.max_by(layer, F.struct(F.col(value), -F.col(layer))).alias("cls"))


def band_argmax(bands: Column, first: int = 2, last: int = 8) -> Column:
    """1-based class with the largest value among bands first .. last."""
    part = F.slice(bands, first, last - first + 1)
    return F.array_position(part, F.array_max(part)).cast("int")


def pyramid(pixels: DataFrame, level: int, value: str = "v") -> DataFrame:
    """Overview: the mean of 2**level by 2**level pixels."""
    return pixels.groupBy(F.shiftright("gx", level).alias("gx"), F.shiftright("gy", level).alias("gy")).agg(F.avg(value).alias("v"))


def resample_nearest(pixels: DataFrame, old: float, new: float) -> DataFrame:
    """Pixels regrouped to another cell size; of several the one nearest to the new centre, then the first by position."""
    df = pixels.withColumns({"_x": (F.col("gx") + 0.5) * old, "_y": (F.col("gy") + 0.5) * old})
    df = df.withColumns({"_gx": F.floor(F.col("_x") / new), "_gy": F.floor(F.col("_y") / new)})
    d = geo.distance(F.col("_x"), F.col("_y"), (F.col("_gx") + 0.5) * new, (F.col("_gy") + 0.5) * new)
    return df.groupBy(F.col("_gx").alias("gx"), F.col("_gy").alias("gy")).agg(F.min_by("v", F.struct(d, "gx", "gy")).alias("v"))


def batches(tiles: DataFrame, most: int) -> DataFrame:
    """batch: number of the mosaic that a chunk's tile goes to; 0 chunks per mosaic: one for all."""
    return tiles.withColumn("batch", F.lit(0) if most == 0 else F.floor(F.col("chunk_id") / most).cast("int"))


def overlay(layers: DataFrame, keys: tuple[str, ...] = ("gx", "gy")) -> DataFrame:
    """Later layers (larger priority) erase earlier ones, pixel by pixel."""
    return layers.groupBy(*keys).agg(F.max_by("cls", F.struct("priority", "cls")).alias("cls"))


def rows_erased_by(base: DataFrame, cover: DataFrame, keys: tuple[str, ...] = ("gx", "gy")) -> DataFrame:
    return base.join(cover, list(keys), "left_anti").unionByName(cover)


def boundary(pixels: DataFrame) -> DataFrame:
    """Filled pixels with an empty neighbour above, below, left or right."""
    filled = pixels.where("v <> 0").select("gx", "gy").distinct()
    steps = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    near = filled.select("gx", "gy", F.inline(steps)).select("gx", "gy", (F.col("gx") + F.col("dx")).alias("nx"), (F.col("gy") + F.col("dy")).alias("ny"))
    full = filled.select(F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    return near.join(full, ["nx", "ny"], "left_anti").select("gx", "gy").distinct()


def polygons(pixels: DataFrame, names: DataFrame, size: float, keys: tuple[str, ...] = ("batch",), drop: tuple[int, ...] = (0,)) -> DataFrame:
    """(*keys, cls, name, region, area_m): regions of equal class, joined by edges, with their area."""
    s = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", cls int, region int, n long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["gy"].to_numpy(), part["gx"].to_numpy()
        image = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), np.int64)
        image[r - r.min(), c - c.min()] = part["cls"]
        rows = []
        for v in np.unique(image[image != 0]):
            regions, k = kernels.label(image == v, eight=False)
            rows += [(int(v), i, int(n)) for i, n in enumerate(np.bincount(regions.ravel(), minlength=k + 1)) if i]
        got = pd.DataFrame(rows, columns=["cls", "region", "n"])
        for k in keys:
            got[k] = part[k].iloc[0]
        return got

    found = pixels.where(~F.col("cls").isin(list(drop))).groupBy(*keys).applyInPandas(run, s)
    return found.join(names.select("cls", "name"), "cls", "left_semi").join(names.select("cls", "name"), "cls").withColumn("area_m", F.col("n") * (size * size)).drop("n")


def coverage(pings: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """ring and area of each chunk: the range edge, then the track backwards. A chunk has a bounded number of pings."""
    edge = F.sort_array(F.collect_list(F.struct("record_num", F.col("range_e").alias("x"), F.col("range_n").alias("y"))))
    track = F.reverse(F.sort_array(F.collect_list(F.struct("record_num", F.col("e").alias("x"), F.col("n").alias("y")))))
    xy = lambda a: F.transform(a, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    df = pings.groupBy(*keys).agg(F.concat(xy(edge), xy(track)).alias("ring"))
    return df.withColumn("area", geo.ring_area(F.col("ring")))


def rubber_sheet(pings: DataFrame, size: float, keys: tuple[str, ...] = (*KEYS, "chunk_id"), every: int = 50, tile: int = 256) -> DataFrame:
    """(*keys, gx, gy, v): a chunk's samples warped between track and range edge, control points at every `every`-th ping and the last.

    Neighbouring pings span a quadrilateral. It goes, with their samples, to each block of tile
    by tile pixels that its bounding box touches, and a block is filled alone by the inverse
    of its quadrilaterals' maps, later pings over earlier ones. So a task holds one block and
    what crosses it, however far a chunk extends. Pixel (gx, gy) takes the value at its
    middle, on the grid that all chunks share. Pings without a position give no quadrilateral;
    missing samples are 0.
    """
    s = ", ".join(f"{k} {pings.schema[k].dataType.simpleString()}" for k in keys) + ", gx long, gy long, v double"
    w = Window.partitionBy(*keys).orderBy("record_num")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = pings.select(*keys, "record_num", F.coalesce("samples", F.array().cast("array<double>")).alias("v0"), F.array(*(F.col(c).cast("double") for c in ("e", "n", "range_e", "range_n"))).alias("_p"))
    rows = rows.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(whole), "rows": F.max(F.size("v0")).over(whole)})
    control = F.when((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n") - 1), F.struct(F.col("_i").alias("i"), F.col("_p").alias("p")))
    rows = rows.withColumns({"_a": F.last(control, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(control, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    share = (F.col("_i") - F.col("_a.i")) / F.greatest(F.col("_b.i") - F.col("_a.i"), F.lit(1))
    rows = rows.withColumn("_at", F.zip_with("_a.p", "_b.p", lambda a, b: a + (b - a) * share))
    quads = rows.withColumns({"v1": F.lead("v0").over(w), "ends": F.concat("_at", F.lead("_at").over(w))})
    quads = quads.where(F.col("rows") > 0).where(F.forall("ends", lambda x: F.coalesce(F.abs(x) < 1e9, F.lit(False)) & ~F.isnan(x)))

    def blocks(first: int) -> Column:
        part = F.transform(F.array(*(F.get("ends", F.lit(i)) for i in range(first, 8, 2))), lambda x: F.floor(x / size / tile))
        return F.sequence(F.array_min(part), F.array_max(part))

    sent = quads.withColumn("bx", F.explode(blocks(0))).withColumn("by", F.explode(blocks(1))).select(*keys, "bx", "by", "record_num", "ends", "rows", "v0", "v1")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("record_num")
        left, low = int(part["bx"].iloc[0]) * tile, int(part["by"].iloc[0]) * tile
        xs, ys = (left + np.arange(tile) + 0.5) * size, (low + np.arange(tile) + 0.5) * size
        out = np.full((tile, tile), np.nan)
        for ends, n, *two in zip(part["ends"], part["rows"], part["v0"], part["v1"]):
            values = np.zeros((n, 2))
            for k, v in enumerate(two):
                values[: len(v), k] = v
            kernels.warp_quad(out, xs, ys, np.asarray(ends, float), values)
        r, c = np.nonzero(np.isfinite(out))
        return pd.DataFrame({**{k: pd.Series([part[k].iloc[0]] * len(r), dtype=object) for k in keys}, "gx": left + c, "gy": low + r, "v": out[r, c]})

    return sent.groupBy(*keys, "bx", "by").applyInPandas(run, s)


def fill_gaps(pixels: DataFrame, reach: int = 2) -> DataFrame:
    """Empty pixels within `reach` of filled ones get their mean weighted by inverse distance; filled ones stay. Each pixel is sent to a fixed number of neighbours."""
    steps = [(a, b, 1.0 / (a * a + b * b) ** 0.5) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (a or b) and a * a + b * b <= reach * reach]
    near = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(w).alias("w")) for a, b, w in steps))
    some = pixels.where("v <> 0").select("gx", "gy", F.col("v").cast("double").alias("v"))
    spread = some.select("gx", "gy", "v", F.inline(near)).groupBy((F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return some.unionByName(spread.join(some.select("gx", "gy"), ["gx", "gy"], "left_anti"))


def interpolate_gaps(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id"), reach: int = 50) -> DataFrame:
    """(*keys, gx, gy, v): a chunk's pixels and, linear between them, its empty ones within `reach` of filled ones, cut back by as many steps at the rim; 0 is no data."""
    s = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", gx long, gy long, v double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["gy"].to_numpy(), part["gx"].to_numpy()
        image = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
        image[r - r.min(), c - c.min()] = part["v"]
        out = kernels.fill_between(image, reach)
        i, j = np.nonzero(np.isfinite(out))
        return pd.DataFrame({**{k: [part[k].iloc[0]] * len(i) for k in keys}, "gx": j + c.min(), "gy": i + r.min(), "v": out[i, j]})

    some = pixels.where("v <> 0 AND NOT isnan(v)").select(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.col("v").cast("double").alias("v"))
    return some.groupBy(*keys).applyInPandas(run, s)


def token(beam: Column) -> Column:
    """The frequency part of a beam's name, for mosaic names."""
    return F.regexp_replace(F.regexp_replace(beam, "^ss_(port|star)_?", ""), "[^A-Za-z0-9]+", "_")
