"""Connected components of an undirected graph held as a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import remove, written


def components(edges: DataFrame, name: str = "graph") -> DataFrame:
    """edges (u, v) -> (id, root): for every node that has an edge the smallest id reachable.

    Edges are held once, from the larger node to the smaller. A large star links all larger
    neighbours of a node to the smallest of the node and its neighbours; a small star links a
    node and its smaller neighbours to the smallest of these. Neither adds edges or changes
    what is connected, and alternating them leaves a star around each smallest node. A path
    halves with every pair of steps, in whatever order its nodes are numbered, so rounds grow
    with the logarithm of the longest path. Each step is one sum per node, aggregated before
    the shuffle, and one join that can be split at a hub; it is written to the shared folder.

    Rows with u = v or a null end are no edges; repeated ones count once; no edges give no rows.
    """
    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    before = _print(e)
    while True:
        for step in (_large, _small):
            grown = written(step(e), f"{name}-edges")
            remove(e)
            e = grown
        after = _print(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _least(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))


def _large(e: DataFrame) -> DataFrame:
    """Each edge's larger end to the smallest neighbour of its smaller end, if that has a smaller one."""
    return e.join(_least(e), e["v"] == F.col("node"), "left").select("u", F.coalesce("least", "v").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, to the smallest of them."""
    near = e.join(_least(e), e["u"] == F.col("node"))
    return near.select(F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v")).distinct()


def _print(e: DataFrame) -> tuple:
    """The number of edges and a checksum over them: equal before and after steps that changed nothing."""
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())
