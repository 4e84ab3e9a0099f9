"""Polygons of classified pixels and joins of points with polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import kernels

RINGS = "array<array<struct<x:double,y:double>>>"


def trace(mask: np.ndarray) -> list[np.ndarray]:
    """The boundary loops of a mask's cells as corner points (row, column), the first point not repeated.

    Each side between a cell and the outside is a directed edge with the cell on its right; at a
    corner where two cells touch diagonally the loop turns right, so loops never cross and a
    region joined by edges has one outer loop and one loop for each hole. Corners on a straight
    line are left out.
    """
    m = np.pad(mask, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
    inner = m[1:-1, 1:-1]
    for (dr, dc), (a, b) in {(-1, 0): ((0, 0), (0, 1)), (0, 1): ((0, 1), (1, 1)), (1, 0): ((1, 1), (1, 0)), (0, -1): ((1, 0), (0, 0))}.items():
        open_ = inner & ~m[1 + dr : m.shape[0] - 1 + dr, 1 + dc : m.shape[1] - 1 + dc]
        for r, c in np.argwhere(open_).tolist():
            edges.setdefault((r + a[0], c + a[1]), []).append((r + b[0], c + b[1]))
    loops = []
    while edges:
        start = min(edges)
        at, way, loop = start, (0, 1), []
        while True:
            out = edges[at]
            if len(out) > 1:  # the right turn: (dr, dc) -> (dc, -dr)
                right = (at[0] + way[1], at[1] - way[0])
                nxt = right if right in out else out[0]
            else:
                nxt = out[0]
            out.remove(nxt)
            if not out:
                del edges[at]
            turn = (nxt[0] - at[0], nxt[1] - at[1])
            if turn != way or not loop:
                loop.append(at)
            way, at = turn, nxt
            if at == start:
                break
        loops.append(np.array(loop, np.int64))
    return loops


def _area(loop: np.ndarray) -> float:
    r, c = loop[:, 0].astype(float), loop[:, 1].astype(float)
    return abs(float(np.sum(c * np.roll(r, -1) - np.roll(c, -1) * r))) / 2


def polygons(pixels: DataFrame, size: float, keys: tuple[str, ...] = ("batch",), drop: tuple[int, ...] = (0,)) -> DataFrame:
    """(*keys, cls, region, rings, area_m): regions of equal class joined by edges. rings[0] is the outer ring, the others are holes; x and y are metres.

    A group's image is held in one task; groups are batches of chunks, which have a bounded size.
    """
    kind = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys) + f", cls int, region int, rings {RINGS}, area_m double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r, c = part["gy"].to_numpy(), part["gx"].to_numpy()
        r0, c0 = r.min(), c.min()
        image = np.zeros((r.max() - r0 + 1, c.max() - c0 + 1), np.int64)
        image[r - r0, c - c0] = part["cls"]
        rows = []
        for v in np.unique(image[image != 0]):
            regions, n = kernels.label(image == v, eight=False)
            top = np.array([(rr.min(), rr.max(), cc.min(), cc.max()) for rr, cc in (np.nonzero(regions == i) for i in range(1, n + 1))]) if n <= 32 else _boxes(regions, n)
            for i, (a, b, d, e) in enumerate(top, 1):
                box = regions[a : b + 1, d : e + 1] == i
                loops = sorted(trace(box), key=_area, reverse=True)
                rings = [[{"x": float((q + d + c0) * size), "y": float((p + a + r0) * size)} for p, q in loop] for loop in loops]
                rows.append((int(v), i, rings, float(box.sum()) * size * size))
        got = pd.DataFrame(rows, columns=["cls", "region", "rings", "area_m"])
        for k in keys:
            got[k] = part[k].iloc[0]
        return got

    return pixels.where(~F.col("cls").isin(list(drop))).select(*keys, "gx", "gy", "cls").groupBy(*keys).applyInPandas(run, kind)


def _boxes(regions: np.ndarray, n: int) -> np.ndarray:
    """First and last row and column of each region, in one pass."""
    r, c = np.nonzero(regions)
    i = regions[r, c] - 1
    out = np.tile([regions.shape[0], -1, regions.shape[1], -1], (n, 1))
    np.minimum.at(out[:, 0], i, r)
    np.maximum.at(out[:, 1], i, r)
    np.minimum.at(out[:, 2], i, c)
    np.maximum.at(out[:, 3], i, c)
    return out


def inside(x: Column, y: Column, rings: Column) -> Column:
    """Whether a point lies in a polygon with holes: an odd number of its rings contain it."""
    return F.size(F.filter(rings, lambda ring: geo.in_ring(x, y, ring))) % 2 == 1


def within(points: DataFrame, shapes: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """points joined with every polygon (rings, ...) that they lie in.

    Points and polygons meet on cells of `cell` metres, a polygon in each cell that its bounding box
    touches, and only then by the exact test: neither side is broadcast, and a crowded cell can be split.
    Points on an edge count as in_ring() does; null coordinates lie nowhere.
    """
    of = lambda c: F.flatten(F.transform("rings", lambda ring: F.transform(ring, lambda p: p[c])))
    low, high = lambda c: F.floor(F.array_min(of(c)) / cell), lambda c: F.floor(F.array_max(of(c)) / cell)
    placed = shapes.withColumn("_cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("_cy", F.explode(F.sequence(low("y"), high("y"))))
    at = points.withColumns({"_cx": F.floor(F.col(x) / cell), "_cy": F.floor(F.col(y) / cell)})
    met = at.join(placed, (at["_cx"] == placed["_cx"]) & (at["_cy"] == placed["_cy"]))
    return met.where(inside(at[x], at[y], placed["rings"])).select(*(at[c] for c in points.columns), *(placed[c] for c in shapes.columns if c not in points.columns))


def fill_holes(rings: Column, least: float = 100.0) -> Column:
    """A polygon's rings without holes of less than `least` square metres."""
    holes = F.filter(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), lambda ring: geo.ring_area(ring) >= least)
    return F.concat(F.slice(rings, 1, 1), holes)


def largest(shapes: DataFrame, keys: tuple[str, ...] = ("batch",)) -> DataFrame:
    """The polygon with most area of each group, the first region on ties."""
    return shapes.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(F.col("area_m"), -F.col("cls"), -F.col("region"))).alias("_s")).select("_s.*")


def concave_loops(x: np.ndarray, y: np.ndarray, most: float) -> list[np.ndarray]:
    """Outlines (positions of points) of the Delaunay triangles without a side longer than `most`; counter-clockwise, holes clockwise."""
    distinct = np.unique(np.stack([x, y], 1).round().astype(np.int64), axis=0)
    if len(distinct) < 3 or np.linalg.matrix_rank(distinct - distinct[0]) < 2:
        return []
    to = kernels.Delaunay(distinct[:, 0].tolist(), distinct[:, 1].tolist()).to
    near = lambda u, v: np.hypot(*(distinct[u] - distinct[v])) <= most
    kept = {(u, v) for (u, v), w in to.items() if min(u, v, w) >= 0 and near(u, v) and near(v, w) and near(w, u)}
    after: dict[int, list[int]] = {}
    for u, v in kept:
        if (v, u) not in kept:
            after.setdefault(u, []).append(v)
    loops = []
    while after:
        u = start = min(after)
        loop, back = [], None
        while True:
            loop.append(u)
            nxt = after[u]
            if len(nxt) > 1 and back is not None:  # where outlines touch, the sharpest left turn keeps them apart
                a = distinct[back] - distinct[u]
                turn = lambda v: np.arctan2(np.cross(a, distinct[v] - distinct[u]), a @ (distinct[v] - distinct[u])) % (2 * np.pi)  # noqa: B023, E731
                v = max(nxt, key=turn)
            else:
                v = nxt[0]
            nxt.remove(v)
            if not nxt:
                del after[u]
            back, u = u, v
            if u == start:
                break
        loops.append(distinct[loop])
    return loops


def hull(points: DataFrame, most: float, keys: tuple[str, ...], x: str = "x", y: str = "y") -> DataFrame:
    """(*keys, rings, area_m): the concave hull of each group's points to the metre: its outer outline first, then what it leaves out.

    Sides are at most `most` metres; several separate pieces give the largest one. A group's points, some 16
    bytes each, are in one task: thin long tracks first (reach.every). Groups on one line have no hull.
    """
    kind = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys) + f", rings {RINGS}, area_m double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        loops = concave_loops(part[x].to_numpy(float), part[y].to_numpy(float), most)
        signed = [(float(np.sum(q[:, 0] * np.roll(q[:, 1], -1) - np.roll(q[:, 0], -1) * q[:, 1])) / 2, q) for q in loops]
        outer = max(signed, key=lambda s: s[0], default=(0.0, None))
        if outer[0] <= 0:
            return pd.DataFrame(columns=[*keys, "rings", "area_m"])
        inner = [s for s in signed if s[0] < 0 and _contains(outer[1], s[1][0])]
        rings = [[{"x": float(a), "y": float(b)} for a, b in q] for _, q in [outer, *sorted(inner, key=lambda s: s[0])]]
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in keys}, "rings": [rings], "area_m": [outer[0] + sum(s[0] for s in inner)]})

    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y).groupBy(*keys).applyInPandas(run, kind)


def _contains(loop: np.ndarray, p: np.ndarray) -> bool:
    a, b = loop, np.roll(loop, -1, 0)
    if (a == p).all(1).any():
        return True
    rising = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((rising & (p[0] < at)).sum() % 2)
