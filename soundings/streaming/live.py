"""Streaming forms of the ping operators, for recordings that are still being written."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def quality(merged: DataFrame) -> DataFrame:
    """(rec_id, at, keep): keep is the state in force at each ping.

    `merged` streams pings (flag null) and log events (flag true or false) as (rec_id, at
    timestamp, record_num, flag). Within a trigger rows are taken in time order, an event before a
    ping of its time; the last state is kept per recording between triggers.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else False
        rows = pd.concat(list(parts))
        rows["_ping"] = rows["flag"].isna()
        out = []
        for r in rows.sort_values(["at", "_ping"], kind="stable").itertuples():
            if r.flag is None or pd.isna(r.flag):
                out.append((key[0], r.at, r.record_num, bool(now)))
            else:
                now = bool(r.flag)
        state.update((now,))
        yield pd.DataFrame(out, columns=["rec_id", "at", "record_num", "keep"])

    kind = merged.schema["rec_id"].dataType.simpleString()
    return merged.groupBy("rec_id").applyInPandasWithState(run, f"rec_id {kind}, at timestamp, record_num long, keep boolean", "keep boolean", "append", GroupStateTimeout.NoTimeout)


def transects(pings: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of pings without a pause of `gap`: session windows per recording with count and depth range."""
    df = pings.withWatermark("at", late).groupBy("rec_id", F.session_window("at", gap).alias("s"))
    return df.agg(F.count("*").alias("n"), F.min("dep_m").alias("least"), F.max("dep_m").alias("most")).select("rec_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "least", "most")


def chunk_stats(pings: DataFrame, width: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """Count and mean depth by recording and tumbling window."""
    return pings.withWatermark("at", late).groupBy("rec_id", F.window("at", width).alias("w")).agg(F.count("*").alias("n"), F.avg("dep_m").alias("mean")).select("rec_id", F.col("w.start").alias("start"), "n", "mean")
