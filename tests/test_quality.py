"""The quality filter's cases: times as text or numbers, offsets, states, ties and errors."""

import pytest
from pyspark.sql import functions as F

from soundings.operators.filters import quality_state


def run(spark, pings, kinds, log, keep="use", field="ts", flag="flag", **more):
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(pings)], "i int, " + kinds)
    d = spark.createDataFrame([(*map(str, r), i) for i, r in enumerate(log)], "ts string, flag string, file_row long")
    got = quality_state(p, d, field, flag, keep, **more)
    return [r["i"] for r in got.where("filter_dq").orderBy("i").collect()]


CLOCK = [("2024-01-01", f"00:00:0{i}") for i in (1, 2, 3)]
SECONDS = [(float(i),) for i in range(1, 6)]


def test_wall_times_with_shift(spark):
    assert run(spark, CLOCK, "date string, time string", [("2024-01-01T00:00:10+00:00", "Use")], shift_seconds=-10) == [0, 1, 2]


def test_offsets(spark):
    log = [("2024-01-01T01:00:00+01:00", "Use")]
    assert run(spark, CLOCK, "date string, time string", log, source_offset=1, target_offset=0) == [0, 1, 2]
    assert run(spark, CLOCK, "date string, time string", log) == []


def test_fractions_and_slashes(spark):
    rows = [("2025-08-10", t) for t in ("08:04:07", "08:04:07.064000", "08:04:07.130000", "08:04:07.195000")]
    assert run(spark, rows, "date string, time string", [("2025/08/10 12:04:07", "Use")], source_offset=0, target_offset=-4) == [0, 1, 2, 3]


def test_numbers(spark):
    assert run(spark, SECONDS, "time_s double", [(2.5, "Use")]) == [2, 3, 4]


def test_states(spark):
    seven = [(float(i),) for i in range(1, 8)]
    assert run(spark, seven, "time_s double", [(2.2, "Use"), (4.1, "NoUse"), (6.4, "Use")]) == [2, 3, 6]


def test_untidy_values(spark):
    assert run(spark, SECONDS[:3], "time_s double", [(1.5, "  usE  ")], keep="  use  , keep ") == [1, 2]


def test_at_event_time(spark):
    assert run(spark, SECONDS[:3], "time_s double", [(2.0, "Use")]) == [1, 2]


def test_last_of_equal_times(spark):
    assert run(spark, SECONDS[:3], "time_s double", [(2.0, "Use"), (2.0, "NoUse")]) == []


@pytest.mark.parametrize(
    "more, said",
    [
        ({"field": None}, "dq_time_field"), ({"flag": None}, "dq_flag_field"), ({"flag": "other"}, "no column other"), ({"keep": ""}, "keep"), ({"keep": []}, "keep"),
        ({"source_offset": 1}, "both UTC offsets"), ({"source_offset": "x", "target_offset": 1}, "number of hours"),
    ],
)
def test_errors(spark, more, said):
    with pytest.raises(ValueError, match=said):
        run(spark, SECONDS, "time_s double", [(1.0, "Use")], **more)


def test_types_differ(spark):
    with pytest.raises(ValueError, match="timestamp types differ"):
        run(spark, SECONDS, "time_s double", [("2024-01-01T00:00:10+00:00", "Use")])


def test_flags_only_shrink(spark):
    from soundings.operators import filters

    p = spark.range(50).select(F.lit("r").alias("rec_id"), F.lit("b").alias("beam"), F.col("id").alias("record_num"), (F.col("id") % 7 / 2.0).alias("speed_ms"), (F.col("id") % 3 == 0).alias("filter"))
    got = filters.speed(p, 1, 2).where("filter").count()
    assert 0 < got <= p.where("filter").count()
