"""Compare a registered query with its DuckDB equivalent."""

import glob
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if isinstance(v, float) and v == int(v) if isinstance(v, float) and v == v and abs(v) < 1e15 else False:
            return int(v)
        return v

    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(repr([plain(v) for v in r]) for r in df.values.tolist())


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
