"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import remove, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any ordered type -> (id, root): for each node with an edge the least node that it is connected with.

    Large and small stars in turn: the larger neighbours of each node are hung on the least of
    all its neighbours, then each node and its smaller neighbours. A node's neighbours meet only in sums
    and joins, never in one row; rounds grow with the logarithm of the longest path.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(e)
    while seen[0]:
        for end in ("v", "u"):
            least = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
            near = e.join(least, e[end] == F.col("node"), "left")
            star = near.select("u", F.coalesce("least", "v").alias("v")) if end == "v" else near.select(F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v"))
            after = written(star.distinct(), "edges")
            remove(e)
            e = after
        before, seen = seen, _digest(e)
        if seen == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
