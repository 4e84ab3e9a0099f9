"""Layout of waterfall exports as tables: tile order, offsets, scroll windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tile_number(path: Column) -> Column:
    """The trailing whole number of a file's stem, null without one."""
    return F.nullif(F.regexp_extract(path, r"(\d+)(?:\.[^./]*)?$", 1), F.lit("")).cast("long")


def ordered(tiles: DataFrame, path: str = "path") -> DataFrame:
    """Tiles in number order, those without a number last, by name."""
    n = tile_number(F.col(path))
    return tiles.withColumn("number", n).orderBy(F.col("number").isNull(), "number", path)


def scaled_height(base: Column, range_m: Column, ref_m: Column) -> Column:
    return F.bround(base * F.least(F.greatest(range_m / ref_m, F.lit(0.25)), F.lit(4.0))).cast("int")


def strip(tiles: DataFrame, keys: tuple[str, ...], order: str = "chunk_id", width: str = "width") -> DataFrame:
    """offset: where each tile starts in the strip of its keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tiles.withColumn("offset", F.coalesce(F.sum(width).over(w), F.lit(0)))


def combined(port: DataFrame, star: DataFrame, key: str = "chunk_id", keys: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Pairs of tiles by chunk, the last chunk first; position is the row of a recording's combined image."""
    return port.join(star, [*keys, key]).withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(key))) - 1)


def positions(length: int, window: int, stride: int, backwards: bool = False) -> list[int]:
    """Starts of scroll windows, the last one flush with the end."""
    if length <= window:
        return [0]
    out = sorted({*range(0, length - window + 1, stride), length - window})
    return out[::-1] if backwards else out


def pad_height(column: Column, height: int, centre: bool = False) -> Column:
    """A column of pixels padded with zeros to `height`, below or on both sides."""
    gap = F.greatest(F.lit(height) - F.size(column), F.lit(0))
    top = F.floor(gap / 2).cast("int") if centre else F.lit(0)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.concat(zeros(top), column, zeros(gap - top))


def fit(width: Column, height: Column, most: int = 20000) -> Column:
    """(width, height) scaled down together so that neither exceeds `most`."""
    k = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.bround(width * k).cast("int").alias("width"), F.bround(height * k).cast("int").alias("height"))
