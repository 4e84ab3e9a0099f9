"""Streams, chunk images, gap filling and batches."""

import numpy as np
from pyspark.sql import functions as F

from soundings.operators import mosaic, samples, substrate, tracks
from soundings.plans import survey
from soundings.streaming import live

RNG = np.random.default_rng(9)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [("r", i * 60, i, None) for i in range(20)] + [("r", 300, 0, True), ("r", 720, 0, False)]
    df = spark.createDataFrame(rows, "rec_id string, s long, record_num long, flag boolean").select("rec_id", F.timestamp_seconds("s").alias("at"), "record_num", "flag", F.lit(2.0).alias("dep_m"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drain(live.quality(stream.select("rec_id", "at", "record_num", "flag")), "kept")
    assert sorted(r["record_num"] for r in got.where("keep").collect()) == list(range(5, 12))
    assert drain(live.transects(stream), "runs", "complete").first()["n"] == 22
    assert drain(live.chunk_stats(stream, "5 minutes"), "stats", "complete").count() == 4


def pixels(spark, a):
    return spark.createDataFrame([(0, r, c, float(a[r, c]), float(c), 0.5) for r in range(a.shape[0]) for c in range(a.shape[1])], "chunk_id int, row int, col int, v double, trk_dist double, pixM double")


def test_chunk_images(spark):
    a = RNG.random((12, 9)) * 100
    px = pixels(spark, a)
    assert samples.correct_speed(px, ("chunk_id",)).agg(F.max("col")).first()[0] == 15
    out = samples.enhance(px, ("chunk_id",), 0, 100, tiles=2)
    assert out.count() == a.size and out.where("v NOT BETWEEN 0 AND 255").count() == 0
    m = np.zeros((9, 6))
    m[1:3, 1:3] = 5
    m[6, 4] = 5
    got = substrate.crop_shadow(pixels(spark, m), ("chunk_id",), margin=2)
    assert got.agg(F.max("row")).first()[0] == 4 and got.where("v <> 0").count() == 4


def test_fill_gaps(spark):
    df = spark.createDataFrame([(0, 0, 4.0), (2, 0, 8.0)], "gx long, gy long, v double")
    got = {(r["gx"], r["gy"]): r["v"] for r in mosaic.fill_gaps(df, 1).collect()}
    assert got[1, 0] == 6.0 and got[0, 0] == 4.0 and got[0, 1] == 4.0 and (3, 1) not in got


def test_interpolate_gaps(spark):
    rows = [("r", "b", k, 10 + x, y, float(1 + x + k)) for k in (0, 1) for x in (0, 9) for y in (0, 3, 9)]
    df = spark.createDataFrame(rows, "rec_id string, beam string, chunk_id int, gx long, gy long, v double")
    got = {(r["chunk_id"], r["gx"], r["gy"]): r["v"] for r in mosaic.interpolate_gaps(df).collect()}
    assert {(k, gx, 5) for k in (0, 1) for gx in range(11, 19)} <= set(got) and all(abs(v - (1 + gx - 10 + k)) < 1e-9 for (k, gx, _), v in got.items())


def test_relinearise(spark):
    df = spark.createDataFrame([("r", "b", 0, i, float(i * i), 0.0) for i in range(11)], "rec_id string, beam string, chunk_id int, record_num int, range_e double, range_n double")
    got = [r["range_e"] for r in tracks.relinearise(df, 5).orderBy("record_num").collect()]
    assert np.allclose(got, np.interp(range(11), [0, 5, 10], [0, 25, 100]))


def test_sliding_prediction(spark):
    assert substrate.window_starts(500, 500, 500) == [166, 333, 500, 667, 834]
    a = RNG.random((4, 22))  # transect 0: chunks of 6, 6 and 4 pings; transect 1: one of 6
    chunk = [0] * 6 + [1] * 6 + [2] * 4 + [3] * 6
    rows = [("r", "b", int(c == 3), c, i, [float(v) for v in a[:, i]]) for i, c in enumerate(chunk)]
    df = spark.createDataFrame(rows, "rec_id string, beam string, transect int, chunk_id int, record_num long, samples array<double>")
    model = lambda x: np.stack([x, np.full(x.shape, x.mean())], 2)
    part = [a[:, :6], a[:, 6:12], a[:, 12:16], a[:, 16:]]
    got = {(r["chunk_id"], r["row"], r["col"]): r for r in survey.map_stage(df, model, survey.Params(nchunk=6)).collect()}
    assert len(got) == a.size
    for c, (left, right) in enumerate([(part[0][:, ::-1], part[1]), (part[0], part[2]), (part[1], part[2][:, ::-1]), (part[3][:, ::-1], part[3][:, ::-1])]):
        whole = np.concatenate([left, part[c], right], 1)
        for col in range(part[c].shape[1]):
            means = [whole[:, s : s + 6].mean() for s in (2, 4, 6, 8, 10) if s <= 6 + col < s + 6]
            for row in range(4):
                assert np.allclose(got[c, row, col]["logits"], [part[c][row, col], np.mean(means)])
                assert got[c, row, col]["cls"] == (1 if part[c][row, col] >= np.mean(means) else 2)


def test_standardise(spark):
    r = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 2.0])], "a array<double>, b array<double>").select(substrate.standardise(F.col("a")).alias("a"), substrate.standardise(F.col("b")).alias("b")).first()
    assert np.allclose(r["a"], [-1.224744871, 0, 1.224744871]) and r["b"] == [0.0, 0.0]


def test_batch_and_params(spark):
    p = survey.Params.from_json('{"nchunk": 5, "other": 1}')
    assert p.nchunk == 5
    pings = spark.createDataFrame([("r1", "b", i, -80.0, 30.0, 1.0, 5.0, 5.0, 10, 0.1) for i in range(12)], "rec_id string, beam string, record_num long, lon double, lat double, speed_ms double, dep_m double, inst_dep_m double, ping_cnt int, pixM double")
    got = {r["rec_id"]: r for r in survey.batch(spark.createDataFrame([("r1",), ("r2",)], "rec_id string"), pings, p).collect()}
    assert got["r1"]["status"] == "done" and got["r1"]["n_chunks"] == 3 and got["r2"]["status"] == "no pings"
