"""Tables that cut lineage, in one run folder of the folder that all executors share."""

from __future__ import annotations

import atexit
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = f"soundings-run-{uuid.uuid4().hex}"
_numbers = itertools.count()
_sessions: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it is unset, one under /tmp/checkpoints. A cluster without it is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not held and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (held or "file:/tmp/checkpoints").rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet to this run's folder and read again."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/{_RUN}"
    if folder not in _sessions:
        _sessions[folder] = spark
        atexit.register(_delete, folder)
    path = f"{folder}/{what}-{next(_numbers)}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    if path := getattr(df, "_stored_path", None):
        _drop(df.sparkSession, path)


def clear_runs(spark: SparkSession) -> int:
    """Delete the folders that earlier runs left behind, as a killed driver does; returns their number. No other run may be under way."""
    fs, root = _at(spark, shared_dir(spark))
    if not fs.exists(root):
        return 0
    old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("soundings-run-") and s.getPath().getName() != _RUN]
    return sum(fs.delete(p, True) for p in old)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def _delete(folder: str) -> None:
    try:
        _drop(_sessions[folder], folder)
    except Exception:  # the session has ended; clear_runs() of a later run takes the folder
        pass
