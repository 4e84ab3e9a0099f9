"""Steps of the stage drivers on small recordings."""

import numpy as np
from pyspark.sql import functions as F

from soundings.operators import depth
from soundings.plans import survey

from test_recordings import recording


def test_the_side_farther_off_goes(spark):
    """Four pairs that differ: by sensor depth, by sensor on a tie, by rolling median without one, and not enough."""
    rows = []
    for i in range(60):
        port, star, sensor = 10.0, 10.0, 10.0
        if i == 10:
            star = 17.0
        elif i == 20:
            port, star, sensor = 7.0, 13.0, 10.0
        elif i == 30:
            port, sensor = 2.0, 0.0
        elif i == 40:
            star = 14.0
        rows += [("r", "ss_port", i, port, sensor), ("r", "ss_star", i + 1000, star, sensor), ("r", "ds_lo", i, 99.0, 1.0)]
    df = spark.createDataFrame(rows, "rec_id string, beam string, record_num long, dep_m double, inst_dep_m double")
    got = {(r["beam"], r["record_num"]) for r in depth.apart(df).where("depth_apart").collect()}
    assert got == {("ss_star", 1010), ("ss_port", 20), ("ss_port", 30)}


def test_the_shorter_side_takes_rows_of_the_longer(spark):
    rec = recording(spark, "a", 10, n=60).where("beam = 'ss_port' OR record_num < 50")
    slow = rec.withColumn("speed_ms", F.when((F.col("beam") == "ss_port") & F.col("record_num").between(20, 29), 0.1).when((F.col("beam") == "ss_star") & (F.col("record_num") == 5), 0.1).otherwise(1.0))
    down = rec.where("beam = 'ss_port'").withColumn("beam", F.lit("ds_lo")).withColumn("inst_dep_m", F.when(F.col("record_num") % 2 == 0, 3.0).otherwise(0.0))
    got = survey.read_stage(slow.unionByName(down), survey.Params(nchunk=10, min_speed=0.5, keep_short=True)).cache()
    at = lambda b: {r["record_num"]: (r["transect"], r["chunk_id"]) for r in got.where(F.col("beam") == b).collect()}
    port, star = at("ss_port"), at("ss_star")
    assert sorted(port) == [*range(20), *range(30, 60)] and sorted(star) == [*range(20), *range(30, 50)] and all(star[k] == port[k] for k in star)
    assert [r["dep_m"] for r in got.where("beam = 'ds_lo'").orderBy("record_num").limit(4).collect()] == [3.0, 5.0, 3.0, 5.0]


def test_missing_pings_lone_sides_and_depths_from_samples(spark):
    n, bed = 60, 18  # the bed is the brighter, smaller part
    rec = recording(spark, "a", 10, n=n).where("beam = 'ss_port'")
    dark = F.transform("samples", lambda v, i: F.when(i < bed, 1.0).otherwise(200.0 + v))
    rec = rec.withColumn("samples", dark).withColumns({"dep_m": F.lit(5.5), "inst_dep_m": F.lit(5.5)})
    got = survey.read_stage(rec, survey.Params(nchunk=20, both_sides=True, depth_source=2, smooth_depth=False)).groupBy("beam", "export").agg(F.count("*").alias("n"), F.min("dep_m").alias("a"), F.max("dep_m").alias("b"))
    assert {(r["beam"], r["export"], r["n"]) for r in got.collect()} == {("ss_port", True, n), ("ss_star", False, n)} and all(abs(r["a"] - bed * 0.5) <= 1.0 and abs(r["b"] - bed * 0.5) <= 1.0 for r in got.collect())
    both = recording(spark, "b", 10, n=n).where("beam = 'ss_port' OR record_num <> 7")
    whole = survey.read_stage(both, survey.Params(nchunk=20, repair_pings=True))
    assert whole.where("record_num = 7").count() == 2 and whole.count() == 2 * n


def test_mosaic_by_zone_with_sink(spark, tmp_path):
    west, east = recording(spark, "w", 10, lat=45.0), recording(spark, "e", 10, lat=45.0, lon=-75.0)
    both = west.unionByName(east).withColumn("ping_bearing", F.lit(180.0)).withColumn("chunk_id", F.lit(0))
    p = survey.Params(pixel=1.0, fill_reach=2)
    got = survey.mosaic_stage(both, p).cache()
    widths = {r["zone"]: r["w"] for r in got.groupBy("zone").agg((F.max("gx") - F.min("gx")).alias("w")).collect()}
    assert widths.keys() == {17, 18} and all(abs(w - 101.7) < 3 for w in widths.values())
    survey.save_mosaic(got, str(tmp_path / "map"), p)
    saved = spark.read.parquet(str(tmp_path / "map"))
    assert {r["zone"] for r in saved.collect()} == {17, 18} and all(bytes(r["tiff"][:4]) == b"II*\0" for r in saved.collect())


def test_shadows_by_a_model(spark):
    rec = recording(spark, "a", 10, n=30).withColumn("chunk_id", F.lit(0)).withColumn("samples", F.transform("samples", lambda v, i: F.when((i >= 8) & (i < 18) & (F.col("record_num") < 25), 0.0).otherwise(v)))

    def model(image):
        dark = (image == 0).astype(float)
        return np.stack([1 - dark, dark], 2)

    got = {(r["beam"], r["record_num"]): r["shadows"] for r in survey.shadow_stage(rec, model).collect()}
    assert len(got) == 60 and all((s is None) == (k[1] >= 25) and (s is None or [(x["a"], x["b"]) for x in s] == [(8, 18)]) for k, s in got.items())
