"""Ping tables, parameters and small inputs; table and image sinks."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PING = (
    "rec_id string, beam string, record_num long, time_s double, date string, time string, utm_e double, utm_n double, e double, n double, lon double, lat double, instr_heading double, "
    "speed_ms double, inst_dep_m double, dep_m double, ping_cnt int, `index` long, son_offset long, pixM double, trk_dist double, volt_scale double, f double, chunk_id int, transect int, "
    "filter boolean, bytes_per_sample int, weighting_factor double, max_abs_adc_raw double, min_pwr_db double, max_pwr_db double"
)
EXTENSIONS = {"dat": "son", "sl2": "sl", "sl3": "sl", "rsd": "rsd", "svlog": "svlog", "jsf": "jsf", "xtf": "xtf"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values as nulls: every float column's NaN."""
    some = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(some) if some else df


def read_pings(spark: SparkSession, path: str) -> DataFrame:
    """Ping table from CSV (header by name) or Parquet, with NaN as null."""
    if path.endswith(".csv"):
        names = spark.read.option("header", True).csv(path).columns
        kinds = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(PING)}
        got = spark.read.option("header", True).schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path)
        return nan_to_null(got)
    return nan_to_null(spark.read.parquet(path))


def write_pings(pings: DataFrame, path: str) -> None:
    pings.write.mode("overwrite").partitionBy("rec_id", "beam").parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("start_seconds double, end_seconds double").csv(path)


def read_quality_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows as text with file_row, their order within the file."""
    return spark.read.option("header", True).csv(path).withColumn("file_row", F.monotonically_increasing_id())


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def find_recordings(spark: SparkSession, folder: str, pattern: str = "*.DAT") -> DataFrame:
    """path, format and stem of recordings below a folder, by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return files.withColumns({"format": F.try_element_at(kind, ext), "stem": F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)})


def coerce_flag(x: Column) -> Column:
    return F.lower(F.trim(x)).isin("1", "true", "yes", "y", "on")


def load_params(text: str, defaults: dict | None = None) -> dict:
    """Parameters from JSON text over defaults; None and NaN fall back."""
    given = {k: v for k, v in json.loads(text or "{}").items() if v is not None and v == v}
    return {**(defaults or {}), **given}


def geojson(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """One line of GeoJSON per row (value): a point feature with the other columns as properties."""
    rest = [c for c in points.columns if c not in (x, y)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return points.select(F.to_json(feature).alias("value"))


def png(image: np.ndarray) -> bytes:
    """An 8-bit grey, 8-bit RGB or 16-bit grey image as PNG."""
    deep = image.dtype == np.uint16
    rgb = image.ndim == 3
    rows = image.astype(">u2" if deep else np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if deep else 8, 2 if rgb else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def geotiff(image: np.ndarray, x0: float, y0: float, size: float, epsg: int) -> bytes:
    """An 8-bit or 16-bit grey image (row 0 at the top) as a deflated GeoTIFF: upper left corner (x0, y0), cells of `size` metres, projection epsg; 0 is no data."""
    deep = image.dtype == np.uint16
    body = zlib.compress(image.astype("<u2" if deep else np.uint8).tobytes())
    keys = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg)  # projected, cells are areas, the projection's code
    short, long_, double, text = (lambda *v: (3, struct.pack(f"<{len(v)}H", *v), len(v))), (lambda *v: (4, struct.pack(f"<{len(v)}I", *v), len(v))), (lambda *v: (12, struct.pack(f"<{len(v)}d", *v), len(v))), (lambda v: (2, v, len(v)))
    tags = {
        256: long_(image.shape[1]), 257: long_(image.shape[0]), 258: short(16 if deep else 8), 259: short(8), 262: short(1), 273: None, 277: short(1), 278: long_(image.shape[0]), 279: long_(len(body)),
        33550: double(size, size, 0.0), 33922: double(0.0, 0.0, 0.0, x0, y0, 0.0), 34735: short(*keys), 42113: text(b"0\0"),
    }
    at = 8 + 2 + 12 * len(tags) + 4
    rest = b"".join(v[1] + b"\0" * (len(v[1]) % 2) for v in tags.values() if v and len(v[1]) > 4)
    tags[273] = long_(at + len(rest))
    out = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for tag, (kind, raw, count) in tags.items():
        out += struct.pack("<HHI", tag, kind, count) + (raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack("<I", at))
        at += len(raw) + len(raw) % 2 if len(raw) > 4 else 0
    return out + struct.pack("<I", 0) + rest + body


def mosaic_images(pixels: DataFrame, epsg: int, size: float, side: int = 2048, value: str = "v", bits: int = 8) -> DataFrame:
    """(tx, ty, tiff): GeoTIFF tiles of side by side cells of a map (gx, gy counted from the projection's origin), rows from north to south."""
    lean = pixels.select(F.floor(F.col("gx") / side).alias("tx"), F.floor(F.col("gy") / side).alias("ty"), "gx", "gy", F.col(value).alias("v"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(part["tx"].iloc[0]), int(part["ty"].iloc[0])
        image = np.zeros((side, side), np.uint16 if bits == 16 else np.uint8)
        image[(ty + 1) * side - 1 - part["gy"].to_numpy(), part["gx"].to_numpy() - tx * side] = part["v"]
        return pd.DataFrame({"tx": [tx], "ty": [ty], "tiff": [geotiff(image, tx * side * size, (ty + 1) * side * size, size, epsg)]})

    return lean.groupBy("tx", "ty").applyInPandas(run, "tx long, ty long, tiff binary")


def tiles(pixels: DataFrame, keys: tuple[str, ...], value: str = "v", bits: int = 8) -> DataFrame:
    """(*keys, png): an image of each group of (row, col, value) pixels. Groups are chunks, which have a fixed size."""
    kind = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + ", png binary"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        image = np.zeros((r.max() + 1, c.max() + 1), np.uint16 if bits == 16 else np.uint8)
        image[r, c] = part[value]
        return part[list(keys)].head(1).assign(png=[png(image)])

    return pixels.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(run, kind)


def raster_table(pixels: DataFrame, epsg: int, x0: float, y0: float, size: float) -> DataFrame:
    """Pixels with their raster's projection, origin and cell size."""
    return pixels.select(F.lit(epsg).alias("epsg"), F.lit(x0).alias("x0"), F.lit(y0).alias("y0"), F.lit(size).alias("xres"), F.lit(-size).alias("yres"), F.col("gy").alias("row"), F.col("gx").alias("col"), F.col("v").alias("val"))


def save_tiles(images: DataFrame, path: str) -> None:
    """Images as a Parquet table of bytes, readable from any store."""
    images.write.mode("overwrite").parquet(path)


def scores_table(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").partitionBy("rec_id", "beam").parquet(path)
