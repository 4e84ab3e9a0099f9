"""Near-duplicate embeddings by a subspace pigeonhole join, exact for a cosine threshold.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. After a rotation, which
keeps distances, the coordinates fall into blocks; if every block of a pair's difference
exceeded its proportional share of that budget, so would the sum. So each linked pair is
close in some block, and the join looks for pairs close in a block only:

1. Equal vectors become one, with a count.
2. In each block a range join: cells as wide as the block's radius along its first two
   coordinates; a vector goes to its own cell and, along each axis, the next one, so every close
   pair meets in exactly one cell as (own, own), (own, next) or (next along one axis, next along the other).
3. A first pass ships a block's coordinates only. Inside a cell vectors are sorted along the
   third coordinate and chunks farther apart than the radius are skipped; for the others a
   float product with a margin names the vectors that some other one may be close to.
4. Only those vectors go, in full, to a second pass over the same cells. There candidates are
   verified in double precision. A pair counts in the first block that it is close in, so
   nothing is counted twice, and a task returns link counts and a spanning forest of its
   links, never all pairs.

In both passes a cell's vectors are dealt to tiles of bounded size and each pair of tiles is
one task, so a cell that holds a third of all vectors is split, not gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import remove, written

#: Vectors of a tile in the first pass (block coordinates, 64 bytes each) and in the second (whole vectors).
WIDE, TILE = 65536, 8192
AXES = 2
SLACK = 1 + 1e-6


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, without null or non-finite components, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(embedding, lambda x: x != 0)


class _Space:
    def __init__(self, d: int, cosine: float, blocks: int):
        self.turn = rotation(d)
        self.edges = [round(i * d / blocks) for i in range(blocks + 1)]
        total = 2 - 2 * cosine
        self.budget = [total * (b - a) / d * SLACK + 1e-12 for a, b in zip(self.edges, self.edges[1:])]
        self.cosine = cosine

    def turned(self, x: np.ndarray) -> np.ndarray:
        # Scaled by the largest component first, so that no square overflows or vanishes.
        x = x / np.abs(x).max(axis=1, keepdims=True)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        # One row at a time the same sums in the same order, whatever else is in the batch.
        return np.einsum("ij,jk->ik", u, self.turn)


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A column of lists of d numbers, none of them null, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * (data.strides[0] if len(data) else 0)
    return pa.BinaryArray.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _cells(space: _Space, rows: DataFrame, d: int) -> DataFrame:
    """no, part (float coordinates of the block), block, cell, side from rows (no, vector): a row for each block and cell that a vector goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            if not len(x):
                continue
            y = space.turned(x)
            for b, (lo, w) in enumerate(zip(space.edges, space.budget)):
                axes = min(AXES, space.edges[b + 1] - lo)
                home = np.floor(y[:, lo : lo + axes] / w**0.5).astype(np.int64)
                part = _binary(y[:, lo : space.edges[b + 1]].astype(np.float32))
                for side in range(1 << axes):
                    at = home + [(side >> k) & 1 for k in range(axes)]
                    cell = (at + 4096) @ np.array([8192**k for k in range(axes)])
                    yield pa.RecordBatch.from_arrays([batch.column(0), part, pa.array(np.full(len(x), b, np.int32)), pa.array(cell), pa.array(np.full(len(x), side, np.int32))], ["no", "part", "block", "cell", "side"])

    return rows.mapInArrow(run, "no long, part binary, block int, cell long, side int")


def _dealt(placed: DataFrame, tile: int) -> DataFrame:
    """placed with tile, ta, tb: a row for each pair of tiles of its cell that a vector is in."""
    # Cells are at most blocks * (2 / width)**2 in number, as coordinates lie in [-1, 1]: this broadcast has a proven bound.
    full = placed.groupBy("block", "cell").agg(F.count("*").alias("c")).select("block", "cell", F.ceil(F.col("c") / tile).cast("int").alias("tiles"))
    own = placed.join(F.broadcast(full), ["block", "cell"]).withColumn("tile", F.pmod(F.xxhash64("no"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return own.select(*placed.columns, "tile", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"))


def _sift(space: _Space, chunk: int = 2048):
    """The first pass over one pair of tiles: (no, block, cell, side) of the vectors that may be close to another one."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        b, tile, other = (k.as_py() for k in (key[0], key[2], key[3]))
        width = space.edges[b + 1] - space.edges[b]
        most = space.budget[b] + 1e-5
        x = np.frombuffer(b"".join(part.column("part").to_pylist()), np.float32).reshape(-1, width)
        along = x[:, min(AXES, width - 1)]
        sides, mine = part.column("side").to_numpy(), part.column("tile").to_numpy() == tile
        open_to = np.zeros(len(x), bool)
        groups: dict[tuple[bool, int], list[np.ndarray]] = {}
        for s in np.unique(sides):
            for m in (True, False):
                at = np.flatnonzero((sides == s) & (mine == m))
                if len(at):
                    at = at[np.argsort(along[at], kind="stable")]
                    groups[m, int(s)] = [at[i : i + chunk] for i in range(0, len(at), chunk)]
        squares = (x * x).sum(1)
        keys = sorted(groups)
        for i, (m1, s1) in enumerate(keys):
            for m2, s2 in keys[i:]:
                if s1 & s2 or (tile != other and m1 == m2):
                    continue
                same = (m1, s1) == (m2, s2)
                for n, p in enumerate(groups[m1, s1]):
                    for q in groups[m2, s2][n if same else 0 :]:
                        gap = max(along[p[0]] - along[q[-1]], along[q[0]] - along[p[-1]], 0.0)
                        if gap * gap > most:
                            continue
                        near = squares[p, None] + squares[None, q] - 2 * (x[p] @ x[q].T) <= most
                        if p is q:
                            np.fill_diagonal(near, False)
                        open_to[p] |= near.any(1)
                        open_to[q] |= near.any(0)
        return part.filter(pa.array(open_to)).select(["no", "block", "cell", "side"])

    return run


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links a-b (positions in ids)."""
    up = np.arange(len(ids))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    us, vs = [], []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            us.append(int(ids[i]))
            vs.append(int(ids[j]))
    return us, vs


def _join(space: _Space, chunk: int = 2048):
    """The second pass over one pair of tiles: rows (no, links) and (u, v), the latter with links null."""

    def pairs(x: dict, y: dict, b: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lo, hi, w = space.edges[b], space.edges[b + 1], space.budget[b]
        p, q = x["t"][:, lo:hi].astype(np.float32), y["t"][:, lo:hi].astype(np.float32)
        pp, qq = (p * p).sum(1), (q * q).sum(1)
        for i in range(0, len(p), chunk):
            for j in range(i if same else 0, len(q), chunk):
                near = pp[i : i + chunk, None] + qq[None, j : j + chunk] - 2 * (p[i : i + chunk] @ q[j : j + chunk].T) <= w + 1e-5
                m, n = np.nonzero(near)
                m, n = m + i, n + j
                if same:
                    m, n = m[m < n], n[m < n]
                for k in range(0, len(m), 65536):
                    a, c = m[k : k + 65536], n[k : k + 65536]
                    diff = (x["t"][a] - y["t"][c]) ** 2
                    first = np.full(len(a), -1)
                    for e in range(len(space.budget) - 1, -1, -1):
                        first[np.ascontiguousarray(diff[:, space.edges[e] : space.edges[e + 1]]).sum(1) <= space.budget[e]] = e
                    mine = first == b
                    a, c = a[mine], c[mine]
                    cos = (x["v"][a] * y["v"][c]).sum(1) / (x["n"][a] * y["n"][c])
                    yield a[cos >= space.cosine], c[cos >= space.cosine]

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        b, tile, other = key[0], key[2], key[3]
        groups: dict[tuple[bool, int], dict] = {}
        raw = np.stack([np.asarray(v, np.float64) for v in part["v"]])
        scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
        whole = {"id": part["id"].to_numpy(), "no": part["no"].to_numpy(), "v": scaled, "n": np.linalg.norm(scaled, axis=1), "t": space.turned(raw), "at": np.arange(len(part)), "k": part["k"].to_numpy()}
        mine, side = part["tile"].to_numpy() == tile, part["side"].to_numpy()
        for s in np.unique(side):
            for m in (True, False):
                pick = (side == s) & (mine == m)
                if pick.any():
                    groups[m, int(s)] = {n: c[pick] for n, c in whole.items()}
        links = np.zeros(len(part), np.int64)
        us, vs = [], []
        keys = sorted(groups)
        for i, (m1, s1) in enumerate(keys):
            for m2, s2 in keys[i:]:
                if s1 & s2 or (tile != other and m1 == m2):
                    continue
                x, y = groups[m1, s1], groups[m2, s2]
                for a, c in pairs(x, y, b, (m1, s1) == (m2, s2)):
                    if len(a):
                        np.add.at(links, x["at"][a], y["k"][c])
                        np.add.at(links, y["at"][c], x["k"][a])
                        u, v = _forest(whole["id"], x["at"][a], y["at"][c])
                        us += u
                        vs += v
        some = links > 0
        got = pd.DataFrame({"u": whole["no"][some], "v": pd.array([None] * int(some.sum()), "Int64"), "links": pd.array(links[some], "Int64")})
        return pd.concat([got, pd.DataFrame({"u": us, "v": pd.array(vs, "Int64"), "links": pd.array([None] * len(us), "Int64")})])

    return run


def groups(vectors: DataFrame, cosine: float = 0.95, blocks: int = 4, tile: int = TILE, wide: int = WIDE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    n_links: other rows with cosine >= cosine (double precision, of the stored components);
    component_id: the smallest vec_id reachable; kept: whether that is the row's own.

    Null, zero and empty vectors and those with null or non-finite components link with
    nothing. Vectors of different lengths are compared within their length. Repeated vectors
    link with each other; rows with equal vec_id count as rows, each with the links of its own
    vector, but are one node. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = rows.where("ok").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("k"))
    classes = written(classes.withColumn("no", F.monotonically_increasing_id()), "vec-classes")
    sizes = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    edges = links = None
    for d in sizes:
        space = _Space(d, cosine, min(blocks, d))
        own = classes.where(F.size("embedding") == d)
        cells = _cells(space, own.select("no", "embedding"), d)
        task = ["block", "cell", "ta", "tb"]
        opened = written(_dealt(cells, wide).groupBy(*task).applyInArrow(_sift(space), "no long, block int, cell long, side int").distinct(), "vec-open")
        whole = _dealt(opened, tile).join(own.select("no", "id", "k", F.col("embedding").alias("v")), "no")
        found = written(whole.groupBy(*task).applyInPandas(_join(space), "u long, v long, links long"), "vec-links")
        remove(opened)
        e, n = found.where("v IS NOT NULL").select("u", "v"), found.where("links IS NOT NULL").groupBy(F.col("u").alias("no")).agg(F.sum("links").alias("links"))
        edges, links = (e, n) if edges is None else (edges.unionByName(e), links.unionByName(n))
    out = rows.select("vec_id", F.when(F.col("ok"), F.col("embedding")).alias("embedding"))
    if edges is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    root = components(edges, "vec")
    told = classes.join(links, "no", "left").join(root, "id", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n"), F.coalesce("root", "id").alias("component"))
    joined = out.join(told, "embedding", "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
