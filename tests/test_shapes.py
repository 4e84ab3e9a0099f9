"""Rings of pixel regions, points in polygons, GeoTIFF bytes, interval filters against brute force."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from soundings.operators import filters, shapes
from soundings.sources import tables

RNG = np.random.default_rng(12)


def test_traced_loops_hold_just_the_cells():
    for _ in range(150):
        m = RNG.random((RNG.integers(1, 9), RNG.integers(1, 9))) < 0.6
        loops = shapes.trace(m)
        r, c = np.indices(m.shape) + 0.5
        odd = np.zeros(m.shape, int)
        for loop in loops:
            for (r1, c1), (r2, c2) in zip(loop, np.roll(loop, -1, 0)):
                if c1 == c2:  # an edge along the rows
                    odd += (c < c1) & (r > min(r1, r2)) & (r < max(r1, r2))
        assert np.array_equal(odd % 2 == 1, m)


def test_polygons_have_holes(spark):
    ring = [("m", x, y, 1) for x in range(10, 15) for y in range(20, 25) if (x, y) not in ((12, 22), (13, 22))] + [("m", 12, 22, 2)]
    df = spark.createDataFrame(ring, "batch string, gx int, gy int, cls int")
    got = {r["cls"]: r for r in shapes.polygons(df, 0.5).collect()}
    assert got[1]["area_m"] == 23 / 4 and len(got[1]["rings"]) == 2 and len(got[2]["rings"]) == 1
    assert sorted((p["x"], p["y"]) for p in got[1]["rings"][0]) == [(5.0, 10.0), (5.0, 12.5), (7.5, 10.0), (7.5, 12.5)]
    assert sorted((p["x"], p["y"]) for p in got[1]["rings"][1]) == [(6.0, 11.0), (6.0, 11.5), (7.0, 11.0), (7.0, 11.5)]


def test_points_within_polygons(spark):
    px = [("m", int(x), int(y), int(RNG.integers(1, 4))) for x in range(12) for y in range(12)]
    found = shapes.polygons(spark.createDataFrame(px, "batch string, gx int, gy int, cls int"), 1.0)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(RNG.random((300, 2)) * 14 - 1)] + [(300, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["cls"] for r in shapes.within(points, found, 3.0).collect()}
    cls = {(x, y): c for _, x, y, c in px}
    want = {r["id"]: cls[int(np.floor(r["x"])), int(np.floor(r["y"]))] for r in points.collect() if r["x"] is not None and (int(np.floor(r["x"])), int(np.floor(r["y"]))) in cls}
    assert got == want and len(got) > 150


def tags(raw):
    sizes = {2: 1, 3: 2, 4: 4, 12: 8}
    (n,) = struct.unpack_from("<H", raw, 8)
    out = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHI", raw, 10 + 12 * i)
        at = 18 + 12 * i if sizes[kind] * count <= 4 else struct.unpack_from("<I", raw, 18 + 12 * i)[0]
        out[tag] = struct.unpack_from(f"<{count}" + {2: "c", 3: "H", 4: "I", 12: "d"}[kind], raw, at)
    return out


def test_geotiff(spark):
    image = RNG.integers(0, 60000, (5, 7)).astype(np.uint16)
    raw = tables.geotiff(image, 500000.0, 3200000.0, 0.25, 32617)
    t = tags(raw)
    assert raw[:4] == b"II*\0" and (t[256], t[257], t[258]) == ((7,), (5,), (16,)) and list(t) == sorted(t)
    assert t[33550] == (0.25, 0.25, 0.0) and t[33922][3:5] == (500000.0, 3200000.0) and t[34735][-1] == 32617
    assert np.array_equal(np.frombuffer(zlib.decompress(raw[t[273][0] : t[273][0] + t[279][0]]), "<u2").reshape(5, 7), image)
    px = spark.createDataFrame([(5, 9, 7.0), (8, 8, 9.0), (3, 8, 4.0)], "gx int, gy int, v double")
    got = {(r["tx"], r["ty"]): r["tiff"] for r in tables.mosaic_images(px, 32617, 0.5, side=4).collect()}
    assert set(got) == {(1, 2), (2, 2), (0, 2)}
    t = tags(got[1, 2])
    assert t[33922][3:5] == (2.0, 6.0)
    a = np.frombuffer(zlib.decompress(got[1, 2][t[273][0] : t[273][0] + t[279][0]]), np.uint8).reshape(4, 4)
    assert a[2, 1] == 7 and a.sum() == 7


def test_time_intervals_against_brute_force(spark):
    t = np.sort(RNG.random(300) * 100).round(2)
    iv = [(float(a), float(a + w)) for a, w in zip((RNG.random(25) * 120 - 10).round(2), RNG.choice([0.0, 1.0, 4.0, 15.0], 25))]
    iv = [(b, a) if i % 3 == 0 else (a, b) for i, (a, b) in enumerate(iv)] + [(None, 5.0), (float(t[7]), float(t[7]))]
    pings = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "record_num int, time_s double")
    got = [r["filter_time"] for r in filters.time_intervals(pings, spark.createDataFrame(iv, "start_seconds double, end_seconds double")).orderBy("record_num").collect()]
    assert got == [any(a is not None and min(a, b) <= x <= max(a, b) for a, b in iv) for x in t]


def test_time_intervals_relative_to_a_long_survey(spark):
    """Intervals that count from the first ping, as said or as guessed, with one of them beyond 1e7 seconds."""
    pings = spark.createDataFrame([(i, 1.7e9 + 4e6 * i) for i in range(5)], "record_num int, time_s double")
    near, far = (3e6, 9e6), (11.9e6, 12.1e6)
    flags = lambda iv, **k: [r["filter_time"] for r in filters.time_intervals(pings, spark.createDataFrame(iv, "start_seconds double, end_seconds double"), **k).orderBy("record_num").collect()]
    assert flags([near, far], relative=True) == [False, True, True, True, False]
    assert flags([near]) == [False, True, True, False, False] and flags([near], relative=False) == [False] * 5
    assert flags([(1.7e9 + a, 1.7e9 + b) for a, b in (near, far)]) == [False, True, True, True, False]


def test_concave_hull(spark):
    grid = [(float(x), float(y)) for x in range(0, 100, 4) for y in range(0, 100, 4) if not (30 < x < 70 and y > 30)]  # a U
    far = [(1000.0, 1000.0), (1001.0, 1000.0), (1000.0, 1001.0)]
    # in an inner corner the triangle of the corner point and its two neighbours belongs to the hull
    df = spark.createDataFrame([("u", x, y) for x, y in grid + far] + [("line", float(i), float(i)) for i in range(9)] + [("u", None, 1.0)], "k string, x double, y double")
    got = shapes.hull(df, 6.0, ("k",)).collect()
    assert [r["k"] for r in got] == ["u"] and got[0]["area_m"] == 96 * 96 - 44 * 68 + 2 * 8 and len(got[0]["rings"]) == 1
    ring = [(float(x), float(y)) for x in range(0, 60, 4) for y in range(0, 60, 4) if not (15 < x < 41 and 15 < y < 41)]
    holed = shapes.hull(spark.createDataFrame([("o", x, y) for x, y in ring], "k string, x double, y double"), 6.0, ("k",)).first()
    assert len(holed["rings"]) == 2 and holed["area_m"] == 56 * 56 - 32 * 32 + 4 * 8
    filled = spark.createDataFrame([(holed["rings"],)], f"rings {shapes.RINGS}").select(F.size(shapes.fill_holes(F.col("rings"), 2000.0)), F.size(shapes.fill_holes(F.col("rings"), 900.0))).first()
    assert tuple(filled) == (1, 2)
