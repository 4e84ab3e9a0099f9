"""Readers of recordings: round trips, byte ranges, damaged files, dispatch by extension."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from soundings.plans import survey
from soundings.sources import files, jsf, son, xtf

PART = {"channel": 0, "slant": 30.0, "frequency": 455, "weight": 0}


def xtf_file(n=6):
    channels = [{"kind": 1, "bytes": 2}, {"kind": 2, "bytes": 2}, {"kind": 1, "bytes": 1}]
    pings = []
    for i in range(n):
        parts = [({**PART, "channel": c, "samples": 10}, (np.arange(10) + i + c).astype("<u2" if c < 2 else np.uint8).tobytes()) for c in range(3)]
        pings.append({"year": 2024, "month": 2, "day": 29, "hour": 1, "second": i, "hundredths": 50, "ping": i, "sensor_x": -81.5, "sensor_y": 29.25, "heading": 12.5, "speed": 2.0, "altitude": 4.5, "parts": parts})
    return xtf.encode(channels, pings)


def jsf_file(n=6):
    ping = {"time": 1_700_000_000, "x": -81 * 600000, "y": 29 * 600000, "units": jsf.ARC_MINUTES, "interval_ns": 40_000, "sound_speed": 1500.0, "start_dahz": 45_000, "end_dahz": 46_000, "altitude_mm": 4500, "weight": 3, "heading": 9050, "most": 99}
    return jsf.encode([({"subsystem": s, "channel": c}, {**ping, "ping": i, "millis": 250}, (np.arange(8) * 8).astype("<u2").tobytes()) for i in range(n) for s in (20, 21) for c in (0, 1)])


def test_xtf(spark, tmp_path):
    (tmp_path / "a.xtf").write_bytes(xtf_file())
    got = xtf.read(spark, str(tmp_path / "a.xtf"))
    assert got.where("error IS NULL").count() == 18
    r = got.where("record_num = 3 AND beam = 'ss_star'").first()
    assert (r["lon"], r["lat"], r["instr_heading"], r["inst_dep_m"], r["ping_cnt"], r["pixM"], r["f"]) == (-81.5, 29.25, 12.5, 4.5, 10, 3.0, 455.0)
    assert r["time_s"] == 1709168403.5 and abs(r["speed_ms"] - 1.028888) < 1e-6
    s = son.samples(spark, str(tmp_path / "a.xtf"), got, big=False)
    assert {tuple(x["samples"]) for x in s.where("record_num = 2 AND beam = 'ss_port_2'").collect()} == {tuple(float(v) for v in range(4, 14))}
    assert s.where("record_num = 2 AND beam = 'ss_star'").first()["samples"][0] == 3.0
    metres = list(xtf.rows(xtf.encode([{"kind": 1, "bytes": 1}], [{"year": 2024, "month": 1, "day": 1, "ship_x": 500000.0, "ship_y": 3200000.0, "parts": []}] + [{"year": 2024, "month": 1, "day": 1, "ship_x": 5e5, "ship_y": 3.2e6, "parts": [({"samples": 1}, b"x")]}], nav_units=0)))
    assert len(metres) == 1 and metres[0][3:7] == (None, None, 5e5, 3.2e6)


def test_jsf(spark, tmp_path):
    other = b"\x01\x16" + bytes([0, 0, 30, 0, 0, 0, 0, 0, 0, 0]) + (5).to_bytes(4, "little") + b"abcde"
    (tmp_path / "a.jsf").write_bytes(b"junk" + jsf_file(2) + other + jsf_file(1))
    got = jsf.read(spark, str(tmp_path / "a.jsf"))
    assert got.where("error IS NULL").count() == 12 and {r["beam"] for r in got.collect()} == {"ss_port", "ss_star", "ss_port_2", "ss_star_2"}
    r = got.first()
    assert (r["lon"], r["lat"], r["instr_heading"], r["inst_dep_m"], r["f"], r["weighting_factor"], r["max_abs_adc_raw"], r["time_s"]) == (-81.0, 29.0, 90.5, 4.5, 455000.0, 3.0, 99.0, 1_700_000_000.25)
    assert abs(r["pixM"] - 0.03) < 1e-12
    assert {tuple(x["samples"]) for x in son.samples(spark, str(tmp_path / "a.jsf"), got, big=False).collect()} == {tuple(float(v) for v in range(8))}


@pytest.mark.parametrize("split", [50, 173, 1000])
def test_son_by_byte_ranges(spark, tmp_path, split):
    rng = random.Random(split)
    pings = [son.encode_ping(72, rng.choice([b"", son.START * 3, bytes([son.END]) * 90, rng.randbytes(rng.randint(0, 200))]), record_num=i, beam_no=3) for i in range(40)]
    data = b"".join(pings)
    paths = [tmp_path / "a.SON", tmp_path / "b.SON"]
    for p in paths:
        p.write_bytes(data)
    spark.dataSource.register(son.SonSource)
    got = spark.read.format("son").option("split", split).load(",".join(map(str, paths)))
    want = [(r[0], r[11]) for r in son.headers(data)]
    assert sorted((r["record_num"], r["index"]) for r in got.collect()) == sorted(want * 2) and len(want) == 40


def test_damaged_files_do_not_end_the_job(spark, tmp_path):
    (tmp_path / "good.xtf").write_bytes(xtf_file())
    (tmp_path / "cut.xtf").write_bytes(xtf_file()[:-700])
    (tmp_path / "bad.xtf").write_bytes(b"nothing")
    (tmp_path / "good.jsf").write_bytes(jsf_file())
    (tmp_path / "empty.jsf").write_bytes(b"")
    (tmp_path / "x.rsd").write_bytes(b"?")
    (tmp_path / "B001.SON").write_bytes(son.START + b"?" * 200)
    got = files.open_all(spark, str(tmp_path))
    by = {r["rec_id"]: (r["n"], r["error"]) for r in got.groupBy("rec_id", F.substring_index("path", ".", -1)).agg(F.count("record_num").alias("n"), F.max("error").alias("error")).collect() if r["rec_id"] != "good"}
    assert by["bad"][0] == 0 and "header" in by["bad"][1] and by["cut"][0] > 0 and "empty" not in by and "no reader" in by["x"][1]
    assert got.where("rec_id = 'good' AND error IS NULL").count() == 18 + 24


def test_batch_tells_damaged_recordings(spark):
    row = "named_struct('beam', 'ss_port', 'record_num', id, 'time_s', double(id), 'lon', -81 + id * 1e-5, 'lat', 29.0D, 'instr_heading', 90.0D, 'speed_ms', 1.0D, 'dep_m', 5.0D, 'inst_dep_m', 5.0D, 'pixM', 0.5D, 'trk_dist', double(id), 'ping_cnt', 30)"
    good = spark.range(120).selectExpr("'a' AS rec_id", f"inline(array({row}))").withColumn("error", F.lit(None).cast("string"))
    fault = good.limit(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in good.schema)).withColumns({"rec_id": F.lit("b"), "error": F.lit("cut off")})
    got = {r["rec_id"]: (r["status"], r["n_pings"], r["error"]) for r in survey.batch(spark.createDataFrame([("a",), ("b",), ("c",)], "rec_id string"), good.unionByName(fault), survey.Params(nchunk=50)).collect()}
    assert got == {"a": ("done", 120, None), "b": ("damaged", 0, "cut off"), "c": ("no pings", 0, None)}


FAKES = (b"\xce\xfa\x00" + bytes(31), b"\x01\x16" * 12, b"\xce\xfa" * 9 + b"\x01\x16\x00\x00\x50\x00" + bytes(20), son.START * 4)


def noisy(kind, seed, n=60):
    """A recording whose samples hold starts of records."""
    rng = random.Random(seed)
    raw = lambda: (rng.choice(FAKES) + rng.randbytes(2 * rng.randint(0, 150)))[: 2 * rng.randint(1, 160)]
    if kind == "xtf":
        pings = []
        for i in range(n):
            cut = [(r := raw(), {**PART, "channel": c, "samples": len(r) // 2}) for c in range(2)]
            pings.append({"year": 2024, "month": 2, "day": 29, "hour": 1, "minute": i % 60, "ping": i, "sensor_x": -81.5, "sensor_y": 29.25, "parts": [(f, r) for r, f in cut]})
        return xtf.encode([{"kind": 1, "bytes": 2}, {"kind": 2, "bytes": 2}], pings)
    return jsf.encode([({"subsystem": 20, "channel": i % 2}, {"time": 1_700_000_000 + i, "ping": i, "units": jsf.ARC_MINUTES, "weight": 3}, raw()) for i in range(n)])


def until_fault(rows):
    try:
        yield from rows
    except ValueError:
        return


@pytest.mark.parametrize("kind", ["xtf", "jsf"])
@pytest.mark.parametrize("split", [61, 257, 1500, 9000])
def test_ranges_equal_the_whole_file(kind, split):
    rows = {"xtf": xtf.rows, "jsf": jsf.rows}[kind]
    for seed in range(8):
        data = noisy(kind, seed)
        assert [r for a in range(0, len(data), split) for r in rows(data, a, min(a + split, len(data)))] == list(rows(data))
        junk = data[:5000] + bytes(range(256)) + data[5000 + 40 * seed :]  # damage in the middle, where reading finds the next record
        assert len([r for a in range(0, len(junk), split) for r in until_fault(rows(junk, a, min(a + split, len(junk))))]) > 30


@pytest.mark.parametrize("block", [70, 300])
def test_small_blocks_read_the_same(tmp_path, block):
    for kind, rows in (("xtf", xtf.rows), ("jsf", jsf.rows)):
        path = tmp_path / f"a.{kind}"
        path.write_bytes(noisy(kind, 3))
        got = files.opened(f"file://{path}")
        got.block = block
        assert list(rows(got)) == list(rows(path.read_bytes()))
    data = files.Bytes.of(b"abcabd" * 50)
    data.block = 4
    assert data.find(b"bd", 0) == 4 and data.find(b"bd", 5) == 10 and data.find(b"bd", 5, 10) == -1 and data.find(b"x", 0) == -1 and data.get(298, 9) == b"bd" and data.get(400, 2) == b""


def test_open_all_by_ranges_with_samples_and_filters(spark, tmp_path):
    (tmp_path / "one.xtf").write_bytes(noisy("xtf", 1))
    (tmp_path / "two.jsf").write_bytes(noisy("jsf", 2))
    (tmp_path / "three and%20 more.xtf").write_bytes(noisy("xtf", 4))
    key = ["rec_id", "beam", "record_num", "samples"]
    whole = files.open_all(spark, str(tmp_path), wanted=files.Wanted(samples=True))
    parts = files.open_all(spark, str(tmp_path), split=700, wanted=files.Wanted(samples=True))
    assert parts.rdd.getNumPartitions() > 30 and whole.where("error IS NOT NULL").count() == 0
    want = sorted(map(tuple, whole.select(key).collect()))
    assert sorted(map(tuple, parts.select(key).collect())) == want and len(want) == 120 + 60 + 120
    later = son.samples(spark, str(tmp_path), whole.drop("samples").where("path LIKE '%xtf'"), big=False, split=500)
    assert sorted(map(tuple, later.select(key).collect())) == [w for w in want if w[0] != "two"]
    some = files.open_all(spark, str(tmp_path), split=700, wanted=files.Wanted(beams=frozenset(["ss_port"]), least=10, most=19))
    assert some.groupBy("rec_id").count().collect() and {tuple(r) for r in some.groupBy("rec_id").count().collect()} == {("one", 10), ("two", 5), ("three and%20 more", 10)}
    table = spark.createDataFrame([(str(tmp_path / "one.xtf"), "xtf"), (str(tmp_path / "gone.xtf"), "xtf"), (str(tmp_path / "x.rsd"), "rsd")], "path string, format string")
    got = files.open_all(spark, table, split=700)
    assert got.where("record_num IS NOT NULL").count() == 120
    assert {(r["rec_id"], r["error"].split(":")[0]) for r in got.where("error IS NOT NULL").collect()} == {("gone", "FileNotFoundError"), ("x", "no reader for rsd format")}


def test_data_sources_take_filters(spark, tmp_path):
    for kind, source in (("xtf", xtf.XtfSource), ("jsf", jsf.JsfSource)):
        path = tmp_path / f"a.{kind}"
        path.write_bytes(noisy(kind, 5))
        spark.dataSource.register(source)
        load = lambda **more: spark.read.format(kind).options(split=900, samples="true", **more).load(str(path))  # noqa: E731, B023
        want = sorted(map(tuple, load().selectExpr("beam", "record_num", "samples").where("record_num >= 7 AND record_num < 30 AND beam = 'ss_star'").collect()))
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        try:
            got = load(filters="true").where("record_num >= 7 AND record_num < 30 AND beam = 'ss_star'").select("beam", "record_num", "samples")
            assert sorted(map(tuple, got.collect())) == want and len(want) > 10
        finally:
            spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = files.FilteringReader("xtf", [str(tmp_path / "a.xtf")], 900, files.Wanted())
    left = list(reader.pushFilters([files.EqualTo(("beam",), "ss_star"), files.GreaterThan(("record_num",), 5), files.LessThanOrEqual(("record_num",), 9), files.GreaterThan(("time_s",), 0.0)]))
    assert [f.attribute for f in left] == [("time_s",)] and {r for p in reader.partitions() for b in reader.read(p) for r in b.column("record_num").to_pylist()} == {6, 7, 8, 9}
