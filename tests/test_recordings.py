"""Several recordings in one table give what each gives alone; map pixels are metres."""

import numpy as np
from pyspark.sql import functions as F

from soundings.functions.windows import by_kernel
from soundings.operators import depth, kernels
from soundings.plans import survey


def recording(spark, name, level, lat=29.0, lon=-81.0, n=130):
    t = np.arange(n)
    rng = np.random.default_rng(len(name) * 7 + int(level))
    rows = [(name, beam, int(i), float(i), float(lon + i * 1e-5), lat, 90.0, 1.0, 5.0, 5.0, 0.5, float(i), 30, [float(x) for x in rng.random(30) * level + 1]) for beam in ("ss_port", "ss_star") for i in t]
    return spark.createDataFrame(
        rows, "rec_id string, beam string, record_num long, time_s double, lon double, lat double, instr_heading double, speed_ms double, dep_m double, inst_dep_m double, pixM double, trk_dist double, ping_cnt int, samples array<double>"
    )


def test_gain_of_two_recordings_equals_each_alone(spark):
    a, b = recording(spark, "a", 10), recording(spark, "loud", 200, n=170)
    p = survey.Params(nchunk=40)
    key = lambda df: {(r["rec_id"], r["beam"], r["record_num"], r["row"]): r["out"] for r in df.collect()}
    gain = lambda df: key(survey.gain_stage(survey.read_stage(df, p), p))
    both, alone = gain(a.unionByName(b)), {**gain(a), **gain(b)}
    assert both.keys() == alone.keys() and len(both) == (130 + 170) * 2 * 20
    assert all(abs(both[k] - alone[k]) < 1e-9 for k in both)


def test_mosaic_pixels_are_metres(spark):
    rec = recording(spark, "a", 10, lat=45.0).withColumn("ping_bearing", F.lit(180.0)).withColumn("chunk_id", F.lit(0))
    got = survey.mosaic_stage(rec, survey.Params(pixel=1.0))
    r = got.agg(F.max("gx") - F.min("gx"), F.max("gy") - F.min("gy"), F.min("zone")).first()
    # 129 steps of 1e-5 degrees of longitude at 45 degrees: 101.7 m, and 14.5 m of range
    assert abs(r[0] - 101.7) < 2 and abs(r[1] - 14.5) < 2 and r[2] == 17


def test_kernels_get_narrow_columns(spark):
    rows = [("r", "b", i // 2, float(i % 7), [1.0] * 3) for i in range(120)]  # every record number twice
    df = spark.createDataFrame(rows, "rec_id string, beam string, record_num long, dep_m double, samples array<double>")
    seen = []

    def run(part):
        return part.assign(n=len(part.columns) + 0.0)

    assert {r["n"] for r in by_kernel(df, ("rec_id", "beam"), "record_num", ("record_num", "dep_m"), {"n": "double"}, run).collect()} == {5.0} and not seen
    got = depth.smooth(df, "dep_m", "s")
    assert got.count() == 120 and got.columns == [*df.columns, "s"]
    v = [r["s"] for r in got.orderBy("record_num", "dep_m").collect()]
    want = kernels.savgol(np.array([r[3] for r in sorted(rows, key=lambda r: (r[2], r[3]))]))
    assert np.allclose(v, want)
    assert "FlatMapGroupsInPandas [rec_id#" in got._jdf.queryExecution().executedPlan().toString()


def test_jumps_are_peeled_beyond_any_number_of_rounds():
    """A staircase of 400 steps, each larger than the one before: every round takes the largest."""
    y = np.concatenate([np.full(30, 0.0), np.cumsum(np.linspace(5, 400, 400))])

    def brute(v, floor):
        v = v.astype(float).copy()
        while True:
            at = np.flatnonzero(np.isfinite(v))
            d = np.abs(np.diff(v[at]))
            cut = max(floor, 6 * np.median(np.abs(d - np.median(d)))) if len(d) else 0
            bad = at[1:][d > cut]
            if not len(bad):
                return v
            v[bad] = np.nan

    got = kernels.drop_jumps(y, 4.0, spikes=False)
    assert np.array_equal(got, brute(y, 4.0), equal_nan=True)
    rng = np.random.default_rng(3)
    for _ in range(200):
        v = np.cumsum(rng.choice([0, 0.1, 3, 9, -8], 90))
        assert np.array_equal(kernels.drop_jumps(v, 1.0, spikes=False), brute(v, 1.0), equal_nan=True)


def test_labels_of_winding_regions():
    n = 401
    spiral = np.zeros((n, n), bool)
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True  # one snake through all rows
    regions, k = kernels.label(spiral, eight=False)
    assert k == 1 and (regions[spiral] == 1).all() and not regions[~spiral].any()
