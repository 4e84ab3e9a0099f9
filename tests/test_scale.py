"""Percentiles and as-of states whose groups are cut, against plain forms."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.functions import windows
from soundings.functions.quantiles import percentiles
from soundings.operators import egn, filters, samples

INF = float("inf")


@pytest.mark.parametrize("bins", [64, 4096])
def test_percentiles_equal_those_of_spark(spark, bins):
    rng = np.random.default_rng(8)
    values = {
        "even": rng.random(700).tolist(), "far": [*np.exp(rng.normal(0, 30, 300)).tolist(), 1.7e308, -1.7e308, 5e-324, -5e-324], "ties": rng.integers(0, 4, 500).astype(float).tolist(), "one": [3.5], "two": [1.0, None, 2.0],
        "none": [None, None], "wild": [INF, -INF, float("nan"), 1.0, 2.0, 0.0, -0.0, None], "burst": [7.0] * 400 + [8.0], None: [1.0, 5.0, 9.0],
    }
    df = spark.createDataFrame([(k, v, "x") for k, vs in values.items() for v in vs], "k string, v double, lo string").repartition(5)
    shares = (0.0, 0.01, 0.25, 0.5, 0.995, 1.0)
    key = lambda d: sorted(((r["k"] or "", [repr(v + 0.0) for v in r["q"]] if r["q"] else None) for r in d.collect()))
    want = df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"))
    assert key(percentiles(df, "v", shares, ("k",), direct=0, bins=bins)) == key(want) == key(percentiles(df, "v", shares, ("k",)))
    finite = df.where("k IN ('even', 'ties', 'burst')")
    for d in (0, 10**6):
        got = percentiles(finite, "v", shares, direct=d, bins=bins).first()["q"]
        assert got == finite.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert percentiles(df.limit(0), "v", shares, direct=d).first()["q"] is None


def _rounded_once(x, share):
    x = sorted(x)
    at = Fraction(len(x) - 1) * Fraction(share)
    low, d = math.floor(at), at - math.floor(at)
    return x[low] if d == 0 else float(Fraction(x[low]) * (1 - d) + Fraction(float(Fraction(x[low + 1]) * d)))


def test_fused_percentiles_round_once(spark):
    rng = np.random.default_rng(3)
    groups = {i: [30 + int(v) * 1e-6 for v in rng.integers(0, 60000, 4 + i % 9)] for i in range(300)}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [(-1, None)], "k int, v double").repartition(5)
    want = {k: [_rounded_once(vs, q) for q in (0.25, 0.75)] for k, vs in groups.items()} | {-1: None}
    for d in (0, 10**6):
        got = {r["k"]: r["q"] for r in percentiles(df, "v", (0.25, 0.75), ("k",), direct=d, fused=True).collect()}
        assert got == want
    assert percentiles(df.where("k = -1"), "v", (0.5,), fused=True).first()["q"] is None
    wild = spark.createDataFrame([(v,) for v in (-INF, -INF, 1.0, INF, INF, INF)], "v double")
    assert percentiles(wild, "v", (0.1, 0.5, 0.9), fused=True).first()["q"] == [-INF, INF, INF]


def test_a_position_on_the_outlier_fence(spark):
    """The last position of each beam stands on the fence of quartiles that are rounded once, so it is kept; adding two rounded products puts some of these fences below it."""
    rng = np.random.default_rng(4)
    rows, lower = [], 0
    for k in range(400):
        v = sorted(30 + int(x) * 1e-6 for x in rng.integers(0, 60000, 11))
        a, b = (_rounded_once([*v, 99.0], q) for q in (0.25, 0.75))  # of 12 values: between the third and fourth, the ninth and tenth
        fence = b + 1.5 * (b - a)
        c, d = 0.25 * v[2] + 0.75 * v[3], 0.75 * v[8] + 0.25 * v[9]
        lower += d + 1.5 * (d - c) < fence
        if max(v) < fence:
            rows += [(str(k), "p", i, 0.0, x) for i, x in enumerate([*v, fence])]
    df = spark.createDataFrame(rows, "rec_id string, beam string, record_num int, lon double, lat double")
    got = filters.coordinate_outliers(df, 1.5)
    assert lower > 20 and len(rows) > 1000 and got.where("record_num = 11 AND NOT filter").count() == 0


def plain(rows, events):
    out = {}
    for i, t in rows:
        known = [(at, keep) for at, keep in events if at is not None and keep is not None and t is not None and at <= t]
        out[i] = max(known)[1] if known else None
    return out


def test_as_of_by_sampled_spans(spark):
    """Two seasons ten years apart, and a burst of rows at one time."""
    r = random.Random(6)
    times = [r.uniform(0, 1000) for _ in range(800)] + [3e8 + r.uniform(0, 1000) for _ in range(800)] + [500.0] * 900
    rows = [*enumerate(times), (9999, None)]
    events = [(r.uniform(0, 1000), r.choice("abc")) for _ in range(60)] + [(3e8 + r.uniform(0, 1000), "d"), (500.0, "e"), (None, "f"), (700.0, None), (-5.0, "g")]
    events = list({at: (at, k) for at, k in events}.values())
    df, ev = spark.createDataFrame(rows, "i long, t double").repartition(4), spark.createDataFrame(events, "at double, k string")
    got = {x["i"]: x["k2"] for x in windows._as_of_all(df, ev, "t", "at", "k", "k2", size=100).collect()}
    assert got == plain(rows, events)
    cuts = windows.time_spans(df, "t", 100)
    sizes = [x["count"] for x in df.groupBy(windows.span_of(F.col("t"), cuts).alias("s")).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert windows._as_of_all(df, ev.limit(0), "t", "at", "k", "k2", size=100).where("k2 IS NOT NULL").count() == 0
    assert windows._as_of_all(df.limit(0), ev, "t", "at", "k", "k2", size=100).count() == 0
    assert {x["i"]: x["k2"] for x in windows._as_of_all(df, ev, "t", "at", "k", "k2").collect()} == got


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_gain_on_arrays_equals_gain_on_pixels(spark, most):
    rng = np.random.default_rng(4)
    rows = []
    for rec, beam, n in (("a", "p", 130), ("a", "s", 90), ("b", "p", 61), ("b", "s", 15)):  # the last has one chunk, so no means
        for i in range(n):
            v = (rng.random(rng.integers(5, 40)) * 200 * (rng.random() < 0.9)).round()
            rows.append((rec, beam, i // 20, i, int(rng.integers(0, 8)), v.tolist()))
    df = spark.createDataFrame(rows, "rec_id string, beam string, chunk_id int, record_num int, bed int, samples array<double>").repartition(5)
    long = df.select("rec_id", "beam", "chunk_id", "record_num", "bed", F.posexplode("samples").alias("row", "v")).where("row >= bed")
    fixed = egn.correct(long, egn.global_means(egn.chunk_means(egn.without_last_chunk(long))))
    want = fixed.join(egn.fold_min_max(egn.min_max(fixed)), "rec_id", "left").withColumn("out", egn.tone(egn.rescale(F.col("egn"), F.col("lo"), F.col("hi")), 1.2, 1.1))
    got = egn.returns_of(egn.correct_arrays(df, egn.gains(egn.row_statistics(df)), 1.2, 1.1, most_bytes=most))
    key = lambda d: {(r["rec_id"], r["beam"], r["record_num"], r["row"]): (r["chunk_id"], r["bed"], r["v"], r["egn"], r["out"]) for r in d.collect()}
    a, b = key(got), key(want)
    assert a.keys() == b.keys() and len(a) > 2000
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_gain_needs_two_scans_and_moves_no_samples(spark, tmp_path):
    df = spark.range(400).selectExpr("'a' AS rec_id", "CAST(id % 2 AS STRING) AS beam", "CAST(id div 50 AS INT) AS chunk_id", "CAST(id AS INT) AS record_num", "3 AS bed", "transform(sequence(1, 60), x -> CAST((x * id) % 17 AS DOUBLE)) AS samples")
    df.write.parquet(str(tmp_path / "p"))
    pings = spark.read.parquet(str(tmp_path / "p"))
    stats, out = egn.row_statistics(pings), None
    out = egn.correct_arrays(pings, egn.gains(stats))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert plan(out).count("samples#") and "SortMergeJoin" not in plan(out) and "Exchange hash" not in plan(out)
    assert plan(stats).count("Scan parquet") >= 1 and "partial_avg" in plan(stats)


def test_stretch_bounds(spark):
    df = spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v")
    assert samples.stretch_bounds(df, "v").first()["lo"] == df.where("v > 0").agg(F.percentile("v", F.lit(0.01))).first()[0]


def test_gain_of_one_recording_is_not_dealt_by_recording(spark):
    """Means and extremes go to the pixels: no exchange of pixels by the few keys, whatever Spark takes for the size of an aggregate."""
    rows = spark.range(4000).selectExpr("1 AS rec_id", "id % 2 AS beam", "id div 1000 AS chunk_id", "id % 8 AS row", "1.0 + id % 13 AS v").withColumn("v", F.col("v").cast("double"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        fixed = egn.correct(rows, egn.global_means(egn.chunk_means(egn.without_last_chunk(rows))))
        got = egn.with_extremes(fixed, egn.fold_min_max(egn.min_max(fixed)))
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString() and got.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
