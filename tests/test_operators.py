"""Operators on small tables with known answers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from soundings.functions import geo
from soundings.functions.windows import fill_linear, unwrap
from soundings.operators import depth, egn, filters, mosaic, reach, samples, substrate, tracks, waterfall
from soundings.plans import survey
from soundings.sources import tables

RNG = np.random.default_rng(5)


def frame(spark, n=60, **columns):
    rows = [("r", "b", i, *(float(c[i]) if c[i] is not None else None for c in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "rec_id string, beam string, record_num long, " + ", ".join(f"{k} double" for k in columns))


def values(df, c):
    return [r[c] for r in df.orderBy("record_num").collect()]


def test_unwrap_equals_numpy(spark):
    a = RNG.random(60) * 360
    df = unwrap(frame(spark, a=a), "a", Window.partitionBy("rec_id").orderBy("record_num"), "u")
    assert np.allclose(values(df, "u"), np.degrees(np.unwrap(np.radians(a))))


def test_fill_linear_equals_numpy(spark):
    v = [None if RNG.random() < 0.4 else float(x) for x in RNG.random(60)]
    df = fill_linear(frame(spark, v=v), "v", ("rec_id",), "record_num", "f")
    at = [i for i, x in enumerate(v) if x is not None]
    assert np.allclose(values(df, "f"), np.interp(range(60), at, [v[i] for i in at]))
    again = fill_linear(df.drop("v"), "f", ("rec_id",), "record_num", "g")
    assert np.allclose(values(again, "g"), values(again, "f"))


def test_as_of_without_key(spark):
    from soundings.functions.windows import as_of

    t, e = np.sort(RNG.random(80)) * 100, np.sort(RNG.random(15)) * 140 - 20
    s = RNG.random(15) > 0.5
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "i int, t double")
    events = spark.createDataFrame([(float(x), bool(y)) for x, y in zip(e, s)], "at double, keep boolean")
    got = [r["k"] for r in as_of(rows, events, "t", "at", "keep", "k").orderBy("i").collect()]
    at = np.searchsorted(e, t, "right") - 1
    assert got == [bool(s[i]) if i >= 0 else None for i in at]


def test_combined_tiles(spark):
    d = spark.createDataFrame([("r", 0, "a"), ("r", 2, "b")], "rec_id string, chunk_id int, path string")
    got = waterfall.combined(d, d.withColumnRenamed("path", "other")).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == [2, 0]


def test_geometry(spark):
    sq = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    r = spark.range(1).select(
        geo.ring_area(sq).alias("a"), geo.in_ring(F.lit(1.0), F.lit(1.0), sq).alias("i"), geo.in_ring(F.lit(5.0), F.lit(1.0), sq).alias("o"), geo.ring_distance(F.lit(6.0), F.lit(1.0), sq).alias("d"),
        geo.bearing(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("b"), geo.segments_cross(*map(F.lit, (0.0, 0.0, 2.0, 2.0, 0.0, 2.0, 2.0, 0.0))).alias("x"),
        geo.utm_epsg(F.lit(-81.0), F.lit(29.0)).alias("z"), *(c.alias(n) for n, c in zip("en", geo.utm(F.lit(-81.0), F.lit(45.0)))),
    ).first()
    assert (r["a"], r["i"], r["o"], r["d"], r["x"], r["z"]) == (12.0, True, False, 2.0, True, "32617")
    assert abs(r["b"] - 90) < 1e-9
    assert abs(r["e"] - 500000) < 1e-3 and abs(r["n"] - 4982950.4) < 1


def test_chunks_and_transects(spark):
    df = frame(spark, v=[1.0] * 60).withColumn("index", F.col("record_num") + F.when(F.col("record_num") >= 25, 5).otherwise(0))
    got = tracks.transects(df, 10).groupBy("transect", "chunk_id").count().orderBy("chunk_id").collect()
    assert [r["count"] for r in got] == [10, 10, 5, 10, 10, 10, 5]
    assert tracks.chunks(df, 25).agg(F.max("chunk_id")).first()[0] == 1  # a tail of 10 joins the chunk before


def test_missing_pings(spark):
    rows = [("r", b, i, float(i)) for i, b in enumerate(["p", "s", "p", "p", "s"])]
    df = spark.createDataFrame(rows, "rec_id string, beam string, record_num long, v double")
    got = tracks.missing_pings(df, ["p", "s"])
    assert got.count() == 6 and got.where("v IS NULL").count() == 1
    assert tracks.missing_pings(df, ["p", "s"], reference_mode=True).count() == 4


@pytest.mark.parametrize("size", [7, 40])
def test_missing_pings_in_blocks(spark, size):
    rng = np.random.default_rng(size)
    rows = [(rec, str(b), i // 2, float(i)) for rec, share in (("r", 0.3), ("s", 0.9), ("t", 0.0)) for i in range(150) for b in [rng.choice(list("pqxy")) if rng.random() < share else "pqxy"[i % 4]]]
    rows += [("u", chr(97 + i), i, 0.0) for i in range(26)] + [("v", "p", i, 0.0) for i in range(60)]  # no cycle ends; every row ends one
    rows = list({r[:3]: r for r in rows}.values())
    df = spark.createDataFrame(rows, "rec_id string, beam string, record_num long, v double")
    want = {}
    for rec in "rstuv":
        seen, cycle = set(), 0
        for _, b, i, _ in sorted((r for r in rows if r[0] == rec), key=lambda r: (r[2], r[1])):
            if b in seen:
                seen, cycle = set(), cycle + 1
            seen.add(b)
            want[rec, b, i] = cycle
    got = tracks.missing_pings(df, [*"abcdefghijklmnopqrstuvwxyz"], size=size).where("v IS NOT NULL")
    assert {(r["rec_id"], r["beam"], r["record_num"]): r["cycle"] for r in got.collect()} == want
    whole = tracks.missing_pings(df, ["p", "q"], reference_mode=True)
    parts = tracks.missing_pings(df, ["p", "q"], reference_mode=True, size=size)
    key = lambda d: sorted((r["rec_id"], r["cycle"], r["beam"], r["record_num"], str(r["v"])) for r in d.collect())
    assert key(parts) == key(whole)


def test_missing_pings_of_many_short_recordings(spark):
    """Recordings that share batches, in several blocks."""
    rng = np.random.default_rng(5)
    rows = [(int(rec), "pqxy"[rng.integers(4)], i, float(i)) for rec in range(3000) for i in range(rng.integers(1, 6))] + [(2**60 + 1, "p", i, float(i)) for i in range(5)] + [(None, "p", 1, 0.0)]
    df = spark.createDataFrame(rows, "rec_id long, beam string, record_num long, v double")
    handed = []
    run = lambda t, ends, bounds: (handed.append(len(bounds) - 1), t)[1]
    told = df.where("rec_id < 3000").orderBy("rec_id", "record_num").toPandas().assign(block=0, first=1)
    back = pd.concat(tracks._in_groups(run)(told.iloc[i : i + 500] for i in range(0, len(told), 500)))
    assert sum(handed) == 3000 and len(handed) < 60 and len(back) == len(told)
    got = tracks.missing_pings(df, [*"pqxy"], size=4000).where("v IS NOT NULL").collect()
    want, last = {}, {}
    for rec, b, i, _ in rows[:-1]:
        seen, cycle = last.get(rec, (set(), 0))
        seen, cycle = ({b}, cycle + 1) if b in seen else (seen | {b}, cycle)
        last[rec], want[rec, b, i] = (seen, cycle), cycle
    assert {(r["rec_id"], r["beam"], r["record_num"]): r["cycle"] for r in got} == want


def test_depth_cleaning(spark):
    d = 10 + np.sin(np.arange(120) / 40)
    bad = d.copy()
    bad[40] = 60
    bad[80] = 0
    df = frame(spark, 120, dep_m=bad, inst_dep_m=d, pixM=[0.1] * 120)
    got = depth.clean(df)
    assert np.abs(np.array(values(got, "dep_m")) - d).max() < 0.3
    assert values(got, "dep_m_interp")[40] == 1


def test_depth_cleaning_removes_a_plateau(spark):
    d = np.full(240, 4.0)
    d[80:140] = 11.0
    got = depth.clean(frame(spark, 240, dep_m=d, inst_dep_m=d, pixM=[0.1] * 240))
    assert np.abs(np.array(values(got, "dep_m")) - 4).max() < 1e-9 and got.where("depth_bad AND dep_m_raw = 11").count() == 60


def test_slant_range(spark):
    v = RNG.random(30)
    df = spark.createDataFrame([(1, 7, [float(x) for x in v])], "k int, bed int, samples array<double>")
    got = {r["i"]: r["filled"] for r in samples.slant_range(df, ("k",)).collect()}
    want = {}
    for i in range(7, 30):
        want[int(np.rint(np.sqrt(i * i - 49)))] = v[i]
    at = sorted(want)
    assert np.allclose([got[i] for i in range(at[-1] + 1)], np.interp(range(at[-1] + 1), at, [want[i] for i in at]))


def test_side_by_side(spark):
    mk = lambda s: spark.createDataFrame([(1, s)], "k int, samples array<double>")
    assert samples.side_by_side(mk([1.0, 2.0]), mk([5.0, 6.0, 7.0]), ("k",)).first()["samples"] == [2.0, 2.0, 1.0, 5.0, 6.0, 7.0]


def test_histogram_counts_all(spark):
    v = RNG.integers(0, 256, 500)
    df = spark.createDataFrame([("b", float(x)) for x in v], "beam string, v double")
    got = {r["bin"]: r["n"] for r in egn.histogram(df).collect()}
    want = np.histogram(v, 255, (0, 255))[0]
    assert all(got.get(i, 0) == want[i] for i in range(255))


def test_softmax_and_windows(spark):
    p = spark.createDataFrame([([1.0, 2.0, 0.5],)], "z array<double>").select(substrate.softmax(F.col("z")).alias("p")).first()["p"]
    e = np.exp([1, 2, 0.5])
    assert np.allclose(p, e / e.sum())
    assert waterfall.positions(10, 4, 3) == [0, 3, 6] and waterfall.positions(11, 4, 3, True) == [7, 6, 3, 0]


def test_polygons_and_coverage(spark):
    px = [("m", x, y, 1 if x < 2 else 2) for x in range(4) for y in range(3)]
    df = spark.createDataFrame(px, "batch string, gx int, gy int, cls int")
    names = spark.createDataFrame([(1, "sand"), (2, "rock")], "cls int, name string")
    got = {r["name"]: r["area_m"] for r in mosaic.polygons(df, names, 0.5).collect()}
    assert got == {"sand": 1.5, "rock": 1.5}
    p = spark.createDataFrame([("r", "b", 0, i, float(i), 0.0, float(i), 5.0) for i in range(4)], "rec_id string, beam string, chunk_id int, record_num int, e double, n double, range_e double, range_n double")
    assert mosaic.coverage(p).first()["area"] == 15.0


def test_overlaps(spark):
    rows = [("r", "b", 0, i, float(i), 0.0, x, 10.0, 10.0) for i, x in enumerate((0.0, 1.0, 0.5, 3.0))]
    p = spark.createDataFrame(rows, "rec_id string, beam string, chunk_id int, record_num int, e double, n double, range_e double, range_n double, range_m double")
    assert [r["overlap"] for r in tracks.overlaps(p).orderBy("record_num").collect()] == [False, False, True, False]
    assert tracks.overlaps(p, reference_mode=True).where("overlap").count() == 0


def test_overlaps_of_the_whole_chunk(spark):
    n = 130  # straight lines but for the 121st, which turns back over the first 20
    rows = [("r", "b", 0, i, float(i), 0.0, float(i), 40.0, 400.0) for i in range(n)]
    rows[120] = ("r", "b", 0, 120, 120.0, 20.0, -10.0, 20.0, 400.0)
    p = spark.createDataFrame(rows, "rec_id string, beam string, chunk_id int, record_num int, e double, n double, range_e double, range_n double, range_m double")
    p = p.where("record_num < 20 OR record_num >= 120").unionByName(p.where("record_num BETWEEN 20 AND 119").withColumns({"n": F.lit(-90.0), "range_n": F.lit(-50.0)}))
    assert [r["record_num"] for r in tracks.overlaps(p).where("overlap").orderBy("record_num").collect()] == [120]
    thin = tracks.overlaps(p, every=10)
    assert thin.count() == n and [r["record_num"] for r in thin.where("overlap").collect()] == [120]
    last = tracks.overlaps(p.where("record_num <= 120"), every=10)  # the last ping stays, what it crosses goes
    assert sorted(r["record_num"] for r in last.where("overlap").collect()) == [0, 10]


def test_survey_stages(spark):
    n = 160
    t = np.arange(n)
    df = frame(spark, n, time_s=t, lon=-81 + t * 1e-5, lat=[29.0] * n, instr_heading=[90.0] * n, speed_ms=[1.0] * n, dep_m=5 + np.sin(t / 20), inst_dep_m=5 + np.sin(t / 20), pixM=[0.5] * n, trk_dist=t)
    df = df.withColumns({"ping_cnt": F.lit(30), "beam": F.lit("ss_port"), "samples": F.transform(F.sequence(F.lit(1), F.lit(30)), lambda x: x.cast("double"))})
    out = survey.run(df, survey.Params(nchunk=50))
    assert out["pings"].count() == n and out["track"].where("range_m = 15").count() == n
    assert out["gain"].where("out BETWEEN 0 AND 255").count() == out["gain"].count() > 0
    assert out["mosaic"].count() > 0


def track(spark, lon, lat, count=30):
    n = len(lon)
    df = frame(spark, n, time_s=np.arange(n) // 2, lon=lon, lat=lat, pixM=[0.5] * n).withColumns({"beam": F.lit("ss_star"), "ping_cnt": F.lit(count), "index": F.col("record_num")})
    return tracks.transects(df, 100)


def test_rectify_smooths_the_course(spark):
    i = np.arange(301)
    jitter = np.where(i % 10, 3e-6 * (-1.0) ** i, 0)
    got = survey.rectify_stage(track(spark, -81 + i * 1e-5, 29 + jitter), survey.Params(nchunk=100))
    assert got.count() == 301 and got.where("abs(ping_bearing - 180) > 0.1").count() == 0
    e, lat = np.array(values(got, "range_e")), np.array(values(got, "range_lat"))
    assert np.ptp(lat) < 1e-8 and (np.diff(np.delete(e, [100, 200, 300])) > 0).all() and got.where("overlap").count() == 0


def test_rectify_leaves_out_overlaps(spark):
    a = np.linspace(0, np.pi, 100)  # a turn to starboard of 10 m radius under a range of 15 m
    got = survey.rectify_stage(track(spark, -81 + 1.03e-4 * -np.cos(a), 29 + 9e-5 * np.sin(a)), survey.Params(nchunk=100))
    assert got.where("overlap").count() > 0 and got.where("overlap AND record_num = 99").count() == 0
    x = {r["record_num"]: r for r in got.collect()}
    kept = [k for k in [*range(0, 100, 10), 99] if not x[k]["overlap"]]
    assert np.allclose([x[k]["range_lon"] for k in range(kept[0], 100)], np.interp(range(kept[0], 100), kept, [x[k]["range_lon"] for k in kept]), atol=1e-12)


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_text("record_num,time_s,extra\n1,2.5,x\n2,NaN,y\n")
    got = tables.read_pings(spark, str(tmp_path / "p.csv")).orderBy("record_num").collect()
    assert got[0]["time_s"] == 2.5 and got[1]["time_s"] is None
    plan = spark.createDataFrame([('{"mission": {"items": [{"polygon": [[1, 2], [3, 4], [5, 6]]}, {"type": "x"}]}}',)], "value string")
    rings = filters.plan_rings(plan).collect()
    assert len(rings) == 1 and rings[0]["ring"][0]["x"] == 2.0
    assert '"Point"' in tables.geojson(spark.createDataFrame([(1.0, 2.0, "a")], "lon double, lat double, n string")).first()["value"]


def test_water_absorption_grows(spark):
    a, b = spark.range(1).select(reach.water_absorption(F.lit(83.0)).alias("a"), reach.water_absorption(F.lit(455.0)).alias("b")).first()
    assert 0 < a < b


def test_read_write_and_names(spark, tmp_path):
    p = spark.createDataFrame([("r", "ss_port_2", 1)], "rec_id string, beam string, record_num long")
    tables.write_pings(p, str(tmp_path / "t"))
    assert tables.read_pings(spark, str(tmp_path / "t")).count() == 1
    assert tracks.side_pairs(p).first()["port"] == "ss_port_2" and tracks.side_pairs(p).first()["star"] is None
    assert tracks.beam_duplicate(p).where("NOT export").first()["beam"] == "ss_star_2"
