"""Regions on tiled maps against one whole image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.functions import graph
from soundings.operators import kernels, regions, shapes


def a_map(seed, h=50, w=70, classes=3, coarse=1, empty=0.3):
    rng = np.random.default_rng(seed)
    small = rng.integers(1, classes + 1, (h // coarse + 1, w // coarse + 1)) * (rng.random((h // coarse + 1, w // coarse + 1)) >= empty)
    image = np.kron(small, np.ones((coarse, coarse), int))[:h, :w]
    image[0, 0] = image[-1, -1] = 1
    return image


def pixels(spark, images, x0=-40, y0=-25):
    rows = [(m, int(c + x0), int(r + y0), int(image[r, c])) for m, image in images.items() for r, c in np.argwhere(image != 0)]
    return spark.createDataFrame(rows, "batch string, gx long, gy long, cls int").repartition(3)


def back(df, m, shape, column="cls", x0=-40, y0=-25):
    out = np.zeros(shape, np.int64)
    for r in df.where(F.col("batch") == m).collect():
        out[r["gy"] - y0, r["gx"] - x0] = r[column] or 0
    return out


@pytest.mark.parametrize("tile", [16, 4096])
def test_regions_equal_those_of_one_image(spark, tile):
    images = {"a": a_map(1), "b": a_map(2, 30, 40, 2, 5)}
    for eight in (False, True):
        got = regions.regions(pixels(spark, images), tile=tile, eight=eight)
        for m, image in images.items():
            ids, sizes = back(got, m, image.shape, "region"), back(got, m, image.shape, "n")
            for v in (1, 2, 3):
                want, n = kernels.label(image == v, eight)
                pairs = {(int(a), int(b)) for a, b in zip(want[want > 0], ids[want > 0])}
                assert len(pairs) == n == len({b for _, b in pairs})
                assert (sizes[want > 0] == np.bincount(want.ravel())[want[want > 0]]).all()
                for i, b in pairs:  # the number of a region is the place of its first pixel
                    r, c = np.argwhere(want == i)[0]
                    assert b == ((int(r) - 25) << 32) + int(c) - 40 + (1 << 31)


@pytest.mark.parametrize("tile", [16, 4096])
def test_sieve_equals_that_of_one_image(spark, tile):
    image = a_map(3, coarse=1, empty=0.1)
    got = regions.sieve(pixels(spark, {"a": image}), 6, tile=tile)
    assert (back(got, "a", image.shape) == np.where(image > 0, kernels.sieve(image, 6), 0)).all()
    assert got.count() == (image > 0).sum()


def filled(image, objects, holes):
    """Round by round on the whole image."""
    kept = np.zeros_like(image)
    for v in np.unique(image[image > 0]):
        kept[kernels.without_small(image == v, objects)] = v
    gap = ~kernels.without_small(kept == 0, holes, eight=False) & (kept == 0)
    out = kept.copy()
    while True:
        p = np.pad(out, 1)
        near = np.stack([p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]).max(0)
        new = np.where(gap & (out == 0), near, out)
        if (new == out).all():
            return out
        out = new


@pytest.mark.parametrize("tile", [16, 4096])
def test_filled_map_equals_that_of_one_image(spark, tile):
    image = a_map(4, coarse=3, empty=0.35)
    got = regions.fill_map(pixels(spark, {"a": image}), 12, 60, tile=tile)
    want = filled(image, 12, 60)
    assert (back(got, "a", image.shape) == want).all() and got.count() == (want > 0).sum()


def test_growth_crosses_many_tiles(spark):
    """A snake that a class enters at one end and another at the other."""
    image = np.zeros((40, 40), int)
    for r in range(0, 40, 2):
        image[r] = 9
        if r + 1 < 40:
            image[r + 1, 39 if r % 4 == 0 else 0] = 9
    image[0, 0], image[38, 0] = 2, 1
    df = pixels(spark, {"a": image}).withColumn("cls", F.when(F.col("cls") < 9, F.col("cls")))
    got = {t: back(regions.grow(df, tile=t), "a", image.shape, "d") for t in (8, 64)}
    assert (got[8] == got[64]).all() and got[8].max() > 300
    alone = spark.createDataFrame([("a", 0, 0, None), ("a", 5, 5, 3)], "batch string, gx long, gy long, cls int")
    assert sorted((r["gx"], r["cls"], r["d"]) for r in regions.grow(alone).collect()) == [(0, 0, None), (5, 3, 0)]


@pytest.mark.parametrize("tile", [8, 4096])
def test_outlines_equal_those_of_one_image(spark, tile):
    image = a_map(5, 60, 70, 2, 2, 0.3)
    image[10:40, 10:50] = 1
    image[15:30, 20:40] = 0
    image[20, 25] = image[21, 26] = 2
    df = pixels(spark, {"a": image, "b": a_map(6, 20, 20)})
    key = lambda r: (r["batch"], r["cls"], r["area_m"], sorted(tuple((p["x"], p["y"]) for p in ring) for ring in r["rings"]))
    got = regions.outlines(df, 0.5, tile=tile).collect()
    assert sorted(map(key, got)) == sorted(map(key, shapes.polygons(df, 0.5).collect()))
    outer = lambda ring: abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, [*ring[1:], ring[0]]))) / 2
    for r in got:
        areas = [outer(x) for x in r["rings"]]
        assert areas[0] == max(areas) and abs(areas[0] - sum(areas[1:]) - r["area_m"]) < 1e-6


def test_empty_and_null_pixels(spark):
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 2, 2, 0)], "batch string, gx long, gy long, cls int")
    for f in (lambda d: regions.regions(d), lambda d: regions.sieve(d, 3), lambda d: regions.fill_map(d, 3, 3), lambda d: regions.outlines(d, 1.0)):
        assert f(df).count() == 0 and f(df.limit(0)).count() == 0


def test_components_of_structs(spark):
    e = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 3, 2), ("b", 9, 9), ("b", 7, 8)], "m string, x long, y long")
    got = graph.components(e.select(F.struct("m", F.col("x").alias("i")).alias("u"), F.struct("m", F.col("y").alias("i")).alias("v")))
    assert {(*r["id"], r["root"]["i"]) for r in got.collect()} == {("a", 1, 1), ("a", 2, 1), ("a", 3, 1), ("b", 2, 2), ("b", 3, 2), ("b", 7, 7), ("b", 8, 7)}


def off(p, ring):
    """The distance of a point to a closed ring."""
    a, b = ring, np.roll(ring, -1, 0)
    d = b - a
    t = np.clip(((p - a) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.sqrt(((a + t[:, None] * d - p) ** 2).sum(1).min())


@pytest.mark.parametrize("tolerance", [0.0, 0.3, 1.5])
def test_simplified_rings_stay_within_tolerance(tolerance):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        turn = np.linspace(0, 2 * np.pi, 200, endpoint=False)
        ring = np.round(np.stack([np.cos(turn), np.sin(turn)], 1) * (20 + rng.random(200)[:, None] * 2), 1)
        got = kernels.simplify_ring(ring, tolerance)
        assert max(off(p, got) for p in ring) <= tolerance + 1e-9 and {tuple(p) for p in got} <= {tuple(p) for p in ring}
        assert tolerance == 0 or len(got) < len(ring)
    square = np.array([[0.0, 0], [1, 0], [2, 0], [2, 2], [0, 2]])
    assert kernels.simplify_ring(square, 0.0).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2]]
    assert len(kernels.simplify_ring(square, 9.0)) == 5 and len(kernels.simplify_ring(np.zeros((5, 2)), 1.0)) == 5


def test_banklines_dissolve_tiles_and_keep_within_tolerance(spark):
    image = (a_map(5, coarse=9, empty=0.4) > 0).astype(int)
    df = pixels(spark, {"m": image})
    one = regions.outlines(df, 0.5, tile=128).collect()
    want = {r["region"]: [[(p["x"], p["y"]) for p in g] for g in r["rings"]] for r in one}
    twice = df.unionByName(df.where("gx % 2 = 0").withColumn("cls", F.lit(7)))  # rasters that overlap, with other values
    for tolerance in (0.1, 1.0):
        got = regions.banklines(twice, 0.5, ("batch",), tolerance, tile=16).collect()
        assert {r["region"] for r in got} == set(want) and [f for f in got[0].asDict()] == ["batch", "region", "rings", "area_m"]
        for r in got:
            rings = [[(p["x"], p["y"]) for p in g] for g in r["rings"]]
            assert len(rings) == len(want[r["region"]])
            assert tolerance > 0.1 or rings == want[r["region"]]
            for whole, simple in zip(want[r["region"]], rings):
                assert max(off(np.array(p), np.array(simple)) for p in whole) <= tolerance + 1e-9
    assert regions.banklines(df.limit(0), 0.5, ("batch",)).count() == 0
