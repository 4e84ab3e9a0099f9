"""Classification of the bed from model scores (logits ARRAY<DOUBLE> per pixel) and its areas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import KEYS
from . import kernels

#: Class groups and marks of the reach summaries and label maps.
SOFT, HARD, OTHER = (1, 2), (3, 4), (5, 6)
WATER, SHADOW = 9, 8


def softmax(logits: Column) -> Column:
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """1-based class of the largest score; the first on ties."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def by_threshold(p: Column, base: Column, four: float = 0.35, three: float = 0.14) -> Column:
    """Class 4 from its probability on, and 3 where it and the argmax allow; else the argmax."""
    return F.when(p[3] >= four, 4).when((p[2] >= three) & (base == 4), 3).otherwise(base).cast("int")


def classify(pixels: DataFrame, method: str = "max", water: str | None = None, shadow: str | None = None) -> DataFrame:
    """cls: class of each pixel; water column 9, shadow 8 where the boolean columns say so."""
    p = softmax(F.col("logits"))
    df = pixels.withColumn("_p", p)
    cls = argmax(F.col("_p"))
    if method == "thresh":
        cls = by_threshold(F.col("_p"), cls)
    if shadow:
        cls = F.when(F.col(shadow), SHADOW).otherwise(cls)
    if water:
        cls = F.when(F.col(water), WATER).otherwise(cls)
    return df.withColumn("cls", cls.cast("int")).drop("_p")


def scaled(scores: Column, kind: str = "probability") -> Column:
    """Scores for rasters: probabilities times 10,000, or logits times 100."""
    k = 10000 if kind == "probability" else 100
    return F.transform(scores, lambda x: F.bround(x * k).cast("int"))


def average_models(raw: DataFrame, egn: DataFrame, keys: tuple[str, ...] = ("chunk_id", "row", "col"), either: bool = False) -> DataFrame:
    """Mean of two models' probabilities; wood (5), flat (2) and other (6) are those of the normalised model.

    either: flat where one of both says so.
    """
    a = raw.select(*keys, softmax(F.col("logits")).alias("_a"))
    b = egn.select(*keys, softmax(F.col("logits")).alias("_b"))
    both = a.join(b, list(keys)).withColumn("p", F.zip_with("_a", "_b", lambda x, y: (x + y) / 2))
    ca, cb = argmax(F.col("_a")), argmax(F.col("_b"))
    own = cb.isin(5, 6) | ((cb == 2) | (ca == 2) if either else cb == 2)
    return both.withColumn("cls", F.when((ca == 2) & own & ~cb.isin(2, 5, 6), 2).when(own, cb).otherwise(argmax(F.col("p"))).cast("int")).drop("_a", "_b")


def confidence(p: Column) -> Column:
    """(mean, population deviation) of a pixel's scores."""
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda a, b: a + b) / n
    return F.struct(mean.alias("mean"), F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n).alias("sd"))


def neighbours(chunks: DataFrame, keys: tuple[str, ...] = (*KEYS, "transect"), value: str = "image") -> DataFrame:
    """left and right: the chunk before and after in the transect, or the chunk itself reversed where none adjoins it."""
    w = Window.partitionBy(*keys).orderBy("chunk_id")
    mirror = F.reverse(F.col(value))
    beside = lambda f, step: F.coalesce(F.when(f("chunk_id").over(w) == F.col("chunk_id") + step, f(value).over(w)), mirror)
    return chunks.withColumn("left", beside(F.lag, -1)).withColumn("right", beside(F.lead, 1))


def window_starts(left: int, width: int, nchunk: int, first: int = 5) -> list[int]:
    """Starts of overlapping windows of nchunk pings around the centre chunk, which has `width` pings behind `left` ones.

    Five at a stride of nchunk / 3 with the centre's in the middle, and more where a wider centre needs them; the first can lie before 0.
    """
    third = nchunk // 3
    stride = max(2 * nchunk // 3 - third, 1)
    out = [left - nchunk + third + k * stride for k in range(first)]
    while out[-1] + nchunk < left + width:
        out.append(out[-1] + stride)
    return out


def merge_windows(windows: list[tuple[int, np.ndarray]], width: int) -> np.ndarray:
    """Mean (rows, width, classes) of windows' scores put at their starts; places that a window lacks, and NaN, do not count."""
    shape = (windows[0][1].shape[0], width, windows[0][1].shape[2])
    total, n = np.zeros(shape), np.zeros(shape)
    for at, scores in windows:
        good = ~np.isnan(scores)
        total[:, at : at + scores.shape[1]] += np.where(good, scores, 0)
        n[:, at : at + scores.shape[1]] += good
    return np.divide(total, n, out=np.full(shape, np.nan), where=n > 0)


def predict_windows(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray], nchunk: int, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """predict() with context: each chunk between its neighbours in the transect, the model run on overlapping windows and its logits averaged."""
    kind = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys) + ", row int, col int, logits array<double>"
    of = [k for k in keys if k != "chunk_id"] + [k for k in ("transect",) if k in chunks.columns and k not in keys]
    pings = F.transform(F.sort_array(F.collect_list(F.struct("record_num", "samples"))), lambda x: x["samples"])
    images = neighbours(chunks.groupBy(*of, "chunk_id").agg(pings.alias("image")), tuple(of)).select(*keys, "left", "image", "right")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        sides = [[np.asarray(s, float) for s in part[c].iloc[0]] for c in ("left", "image", "right")]
        all3 = [s for side in sides for s in side]
        n, left, width = max(map(len, all3)), len(sides[0]), len(sides[1])
        image = np.stack([np.pad(s, (0, n - len(s))) for s in all3], 1)
        spans = [(max(a, 0), min(a + nchunk, len(all3))) for a in window_starts(left, width, nchunk)]
        out = merge_windows([(a, model(image[:, a:b]).astype(float)) for a, b in spans if a < min(b, left + width) and b > left], len(all3))
        out = out[: max(map(len, sides[1])), left : left + width]
        r, c = np.indices(out.shape[:2])
        got = pd.DataFrame({k: [part[k].iloc[0]] * r.size for k in keys})
        return got.assign(row=r.ravel().astype(np.int32), col=c.ravel().astype(np.int32), logits=list(out.reshape(-1, out.shape[2])))

    return images.groupBy(*keys).applyInPandas(run, kind)


def predict(chunks: DataFrame, model: Callable[[np.ndarray], np.ndarray], keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """(*keys, row, col, logits) by an injected model: image (rows, pings) -> (rows, pings, classes)."""
    kind = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys) + ", row int, col int, logits array<double>"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("record_num")
        n = max(map(len, part["samples"]))
        out = model(np.stack([np.pad(np.asarray(s, float), (0, n - len(s))) for s in part["samples"]], 1))
        r, c = np.indices(out.shape[:2])
        got = pd.DataFrame({k: [part[k].iloc[0]] * r.size for k in keys})
        return got.assign(row=r.ravel().astype(np.int32), col=c.ravel().astype(np.int32), logits=list(out.reshape(-1, out.shape[2]).astype(float)))

    return chunks.groupBy(*keys).applyInPandas(run, kind)


def shadow_spans(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "record_num"), far_only: bool = False) -> DataFrame:
    """spans ARRAY<STRUCT<a, b>> [a, b) of runs of rows with mask true in each ping; far_only keeps those that reach the last row."""
    df = pixels.withColumn("_last", F.max("row").over(Window.partitionBy(*keys))).where("mask")
    run = F.col("row") - F.row_number().over(Window.partitionBy(*keys).orderBy("row"))
    spans = df.withColumn("_g", run).groupBy(*keys, "_g").agg(F.min("row").alias("a"), (F.max("row") + 1).alias("b"), F.max("_last").alias("_last"))
    if far_only:
        spans = spans.where("b = _last + 1")
    return spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _image(name: str, f: Callable[[np.ndarray], np.ndarray], pixels: DataFrame, keys: tuple[str, ...], value: str, out: str, kind: str) -> DataFrame:
    s = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in (*keys, "row", "col")) + f", {out} {kind}"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["row"].to_numpy(), part["col"].to_numpy()
        image = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), part[value].to_numpy().dtype)
        image[r - r.min(), c - c.min()] = part[value]
        return part[[*keys, "row", "col"]].assign(**{out: f(image)[r - r.min(), c - c.min()]})

    return pixels.select(*keys, "row", "col", value).groupBy(*keys).applyInPandas(run, s)


def clean_mask(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id"), holes: int = 100, objects: int = 100, value: str = "mask") -> DataFrame:
    """mask without holes and regions below the given sizes."""
    return _image("mask", lambda m: kernels.without_small(kernels.without_holes(m.astype(bool), holes), objects), pixels, keys, value, "mask", "boolean")


def sieve(pixels: DataFrame, least: int, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    """cls with regions of fewer than `least` pixels given to a neighbour."""
    return _image("sieve", lambda m: kernels.sieve(m, least), pixels, keys, "cls", "cls", "int")


def erode(pixels: DataFrame, times: int = 1, keys: tuple[str, ...] = (*KEYS, "chunk_id")) -> DataFrame:
    return _image("erode", lambda m: kernels.erode(m, times), pixels, keys, "cls", "cls", "int")


def fill_zero_runs(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "record_num")) -> DataFrame:
    """Zeros in a ping take the last class above them, or the first below where none is."""
    up, down = Window.partitionBy(*keys).orderBy("row"), Window.partitionBy(*keys).orderBy(F.desc("row"))
    v = F.when(F.col("cls") != 0, F.col("cls"))
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("cls", F.coalesce(F.last(v, ignorenulls=True).over(frame(up)), F.last(v, ignorenulls=True).over(frame(down)), F.lit(0)))


def area_shares(areas: DataFrame, keys: tuple[str, ...], area: str = "area", cls: str = "cls") -> DataFrame:
    """Area and share of soft, hard and other classes."""
    part = lambda ids: F.coalesce(F.sum(F.when(F.col(cls).isin(list(ids)), F.col(area))), F.lit(0.0))
    df = areas.groupBy(*keys).agg(F.sum(area).alias("total"), part(SOFT).alias("soft"), part(HARD).alias("hard"), part(OTHER).alias("other"))
    return df.withColumns({f"{c}_share": F.col(c) / F.col("total") for c in ("soft", "hard", "other")})


def class_shares(areas: DataFrame, keys: tuple[str, ...], classes: list[str], area: str = "area", cls: str = "substrate") -> DataFrame:
    """<class>_prop and <class>_patch_count per class, missing ones 0."""
    total = F.sum(area)
    return areas.groupBy(*keys).agg(
        *(f for c in classes for f in (F.coalesce(F.sum(F.when(F.col(cls) == c, F.col(area))) / total, F.lit(0.0)).alias(f"{c}_prop"), F.count(F.when(F.col(cls) == c, 1)).alias(f"{c}_patch_count")))
    )


def standardise(samples: Column) -> Column:
    """Samples with mean 0 and deviation 1, as a model takes them; zeros where all are equal."""
    n = F.size(samples)
    mean = F.aggregate(samples, F.lit(0.0), lambda a, b: a + b) / n
    sd = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, b: a + (b - mean) * (b - mean)) / n)
    return F.transform(samples, lambda x: F.coalesce(F.try_divide(x - mean, sd), F.lit(0.0)))


def crop_shadow(pixels: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id"), margin: int = 50, value: str = "v") -> DataFrame:
    """Pixels of the topmost connected region of nonzero values, other values 0, cropped below its deepest row plus `margin`."""

    def top(image: np.ndarray) -> np.ndarray:
        regions, n = kernels.label(image != 0)
        if not n:
            return image
        keep = regions == regions[tuple(np.argwhere(regions > 0)[0])]
        deepest = np.flatnonzero(keep.any(1)).max()
        out = np.where(keep, image, 0).astype(float)
        out[min(len(out), deepest + margin + 1) :] = np.nan
        return out

    got = _image("crop", top, pixels, keys, value, value, "double")
    return got.where(F.col(value).isNotNull() & ~F.isnan(value))
