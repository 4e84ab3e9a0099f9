"""Tables that cut lineage, kept where every executor can read them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where it is unset, one under /tmp/checkpoints.

    A cluster without the setting is an error: a machine-local folder would not be
    seen by the other executors.
    """
    held = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not held:
        try:
            held = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # the key is unset
            held = None
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:/tmp/checkpoints"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written once as Parquet to the shared folder and read again; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    out = spark.read.parquet(path)
    out._shared_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete a table made by written() once nothing will read it again."""
    path = getattr(df, "_shared_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its shared folder is the cluster's to empty
            return
