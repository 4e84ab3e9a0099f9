"""Regions of equal class on maps of any extent: labelling, sieving, filled holes and outlines, tile by tile.

A map is a table of pixels (map keys, gx, gy, cls); class 0, null and absent pixels are background.
A task holds one tile. Regions are labelled within tiles, labels that touch across a seam are the
edges of a graph, and its components are the regions of the map, so results do not depend on how a
map is cut. A region's number is the place of its first pixel in scan order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import components
from ..functions.stored import remove, written
from . import kernels

TILE = 256
RINGS = "array<array<struct<x:double,y:double>>>"
_NEVER = np.iinfo(np.int32).max


def _kind(df: DataFrame, keys: tuple[str, ...], rest: str) -> str:
    return ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), rest])


def _by_map(df: DataFrame, maps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """df with what maps, one row a map, say of its map; without keys there is one map and one row."""
    return df.join(maps, list(keys)) if keys else df.crossJoin(F.broadcast(maps))


def _cells(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"_tx": F.floor(F.col("gx") / tile), "_ty": F.floor(F.col("gy") / tile)})


def _on_seam(tile: int) -> Column:
    return F.pmod("gx", F.lit(tile)).isin(0, tile - 1) | F.pmod("gy", F.lit(tile)).isin(0, tile - 1)


def extent(pixels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """_x0, _x1, _y0, _y1 of each map: one row a map."""
    return pixels.groupBy(*keys).agg(F.min("gx").alias("_x0"), F.max("gx").alias("_x1"), F.min("gy").alias("_y0"), F.max("gy").alias("_y1"))


def _with_keys(key: tuple, keys: tuple[str, ...], part: pa.Table, rows: int, columns: dict) -> pa.Table:
    held = {k: pa.array([v.as_py()] * rows, part.schema.field(k).type) for k, v in zip(keys, key)}
    return pa.table({**held, **columns})


def _label(keys: tuple[str, ...], tile: int, eight: bool, background: int):
    """One tile -> (keys, gx, gy, cls, node, n): its pixels with the place of their region's first pixel in the tile.

    Background is labelled too where `background` is positive. Of background regions at least that
    large only what lies on the tile's rim is given, and one more pixel that stands for the rest.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() * tile for k in key[-2:])
        image = np.zeros((tile, tile), np.int64)
        image[part["gy"].to_numpy() - ty, part["gx"].to_numpy() - tx] = part["cls"].to_numpy()
        rows, cols, classes, nodes, counts = [], [], [], [], []

        def add(regions: np.ndarray, v: int) -> None:
            r, c = np.nonzero(regions)
            i = regions[r, c]
            _, first, size = np.unique(i, return_index=True, return_counts=True)
            n = np.ones(len(r), np.int64)
            if v == 0:
                large = size >= background
                rim = (r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1)
                inner = np.bincount(i[~rim] - 1, minlength=len(size))
                rest = np.flatnonzero(large & (inner > 0))
                keep = rim | ~large[i - 1]
                inside = np.flatnonzero(~rim)
                at, where = np.unique(i[inside] - 1, return_index=True)
                stand = inside[where[np.isin(at, rest)]]
                n[stand] = inner[at[np.isin(at, rest)]]
                keep[stand] = True
            else:
                keep = np.ones(len(r), bool)
            node = ((r[first] + ty).astype(np.int64) << 32) + (c[first] + tx + (1 << 31))
            for to, x in ((rows, r[keep] + ty), (cols, c[keep] + tx), (classes, np.full(int(keep.sum()), v)), (nodes, node[i[keep] - 1]), (counts, n[keep])):
                to.append(x.astype(np.int64))

        for v in np.unique(image[image != 0]):
            add(kernels.label(image == v, eight)[0], int(v))
        if background:
            x0, x1, y0, y1 = (part[c][0].as_py() for c in ("_x0", "_x1", "_y0", "_y1"))
            empty = image == 0
            empty[: max(0, y0 - ty)] = empty[max(0, y1 - ty + 1) :] = False
            empty[:, : max(0, x0 - tx)] = empty[:, max(0, x1 - tx + 1) :] = False
            add(kernels.label(empty, eight)[0], 0)
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cols, rows, classes, nodes, counts)]
        return _with_keys(key, keys, part, len(whole[0]), {n: pa.array(x.astype(t)) for n, x, t in zip(("gx", "gy", "cls", "node", "n"), whole, (np.int64, np.int64, np.int32, np.int64, np.int64))})

    return run


def _neighbours(tile: int, eight: bool) -> Column:
    """The places across the right and lower seams that touch a pixel."""
    step = lambda dx, dy: F.struct((F.col("gx") + dx).alias("nx"), (F.col("gy") + dy).alias("ny"))
    side = range(-1, 2) if eight else (0,)
    none = F.array().cast("array<struct<nx:bigint,ny:bigint>>")
    right = F.when(F.pmod("gx", F.lit(tile)) == tile - 1, F.array(*(step(1, d) for d in side))).otherwise(none)
    below = F.when(F.pmod("gy", F.lit(tile)) == tile - 1, F.array(*(step(d, 1) for d in side))).otherwise(none)
    return F.concat(right, below)


def _regions(pixels: DataFrame, keys: tuple[str, ...], tile: int, eight: bool, background: int = 0, bounds: DataFrame | None = None) -> DataFrame:
    """(keys, gx, gy, cls, region, n): pixels, and those of background regions of fewer than `background`, with their region's size.

    Background ends at the bounds. Where it reaches a tile without any pixel it counts as large.
    """
    some = pixels.where("cls <> 0").select(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.col("cls").cast("int").alias("cls"))
    box = bounds if bounds is not None else extent(some, keys)
    if background:
        some = _by_map(some, box, keys)
    kind = _kind(some, keys, "gx long, gy long, cls int, node long, n long")
    labelled = written(_cells(some, tile).groupBy(*keys, "_tx", "_ty").applyInArrow(_label(keys, tile, eight, background), kind), "labels")

    rim = labelled.where(_on_seam(tile))
    place = lambda df, a: F.struct(*(df[k] for k in keys), df[a])
    near = rim.select(*keys, "cls", "node", F.inline(_neighbours(tile, eight)))
    over = rim.select(*keys, F.col("gx").alias("nx"), F.col("gy").alias("ny"), "cls", F.col("node").alias("next"))
    met = near.join(over, [*keys, "nx", "ny", "cls"])
    roots = components(met.select(F.struct(*keys, "node").alias("u"), F.struct(*keys, F.col("next").alias("node")).alias("v")))

    sizes = labelled.groupBy(*keys, "cls", "node").agg(F.sum("n").alias("n"))
    if background:
        out = F.array(*(F.struct((F.col("gx") + a).alias("nx"), (F.col("gy") + b).alias("ny")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))
        beyond = rim.where("cls = 0").select(*keys, "gx", "gy", "cls", "node", F.inline(out)).where(f"floor(nx / {tile}) <> floor(gx / {tile}) OR floor(ny / {tile}) <> floor(gy / {tile})")
        beyond = _by_map(beyond, box, keys).where("nx BETWEEN _x0 AND _x1 AND ny BETWEEN _y0 AND _y1").join(over.select(*keys, "nx", "ny"), [*keys, "nx", "ny"], "left_anti")
        sizes = sizes.unionByName(beyond.select(*keys, "cls", "node").distinct().withColumn("n", F.lit(background).cast("long")))
    held = sizes.join(roots.select("id.*", F.col("root.node").alias("root")), [*keys, "node"], "left").withColumn("region", F.coalesce("root", "node"))
    total = held.groupBy(*keys, "region").agg(F.sum("n").alias("n"))
    known = held.select(*keys, "node", "region").distinct().join(total, [*keys, "region"])
    return labelled.drop("n").join(known, [*keys, "node"]).select(*keys, "gx", "gy", "cls", "region", "n")


def regions(pixels: DataFrame, keys: tuple[str, ...] = ("batch",), tile: int = TILE, eight: bool = False) -> DataFrame:
    """(keys, gx, gy, cls, region, n): each pixel's region of equal class, joined by sides (or corners too), and its number of pixels. Background pixels are left out."""
    return _regions(pixels, keys, tile, eight)


def _flood(far: np.ndarray, label: np.ndarray, open_: np.ndarray) -> None:
    """Distances and labels of open places from the others, by sides, in place; of equally near labels the largest."""
    width = far.shape[1]
    far, label, open_ = far.ravel(), label.ravel(), open_.ravel()
    seeds = np.flatnonzero(far != _NEVER)
    seeds = seeds[np.argsort(far[seeds], kind="stable")]
    levels, first = np.unique(far[seeds], return_index=True)
    waiting = {int(v): part for v, part in zip(levels, np.split(seeds, first[1:]))}
    front, level = np.zeros(0, np.int64), -1
    while len(front) or waiting:
        level = level + 1 if len(front) else min(waiting)
        front = np.concatenate([front, waiting.pop(level, np.zeros(0, np.int64))])
        got = []
        for step in (-width, -1, 1, width):
            to = front + step
            ok = (to >= 0) & (to < len(far))
            a, to = front[ok], to[ok]
            ok = open_[to] & (far[to] > level)
            a, to = a[ok], to[ok]
            far[to] = level + 1
            np.maximum.at(label, to, label[a])
            got.append(to)
        front = np.unique(np.concatenate(got))


def _grow(keys: tuple[str, ...], tile: int):
    """One tile with the pixels around it -> its own pixels with labels grown as far as the tile allows."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() * tile - 1 for k in key[-2:])
        r, c = part["gy"].to_numpy() - ty, part["gx"].to_numpy() - tx
        cls, d = part["cls"].to_numpy(), part["d"].to_numpy()
        own = (r > 0) & (r <= tile) & (c > 0) & (c <= tile)
        mine = own & part["open"].to_numpy()
        far, label, open_ = np.full((tile + 2, tile + 2), _NEVER), np.zeros((tile + 2, tile + 2), np.int64), np.zeros((tile + 2, tile + 2), bool)
        seed = ~mine & (cls > 0)
        far[r[seed], c[seed]], label[r[seed], c[seed]] = d[seed], cls[seed]
        open_[r[mine], c[mine]] = True
        _flood(far, label, open_)
        beside = open_.copy()
        for axis, way in ((0, 1), (0, -1), (1, 1), (1, -1)):
            beside |= np.roll(open_, way, axis)  # the rim is never open, so nothing wraps round
        now, new = far[r, c], label[r, c]
        rim = (r == 1) | (c == 1) | (r == tile) | (c == tile)
        held = own.nonzero()[0]
        columns = {"gx": part["gx"].take(pa.array(held)), "gy": part["gy"].take(pa.array(held)), "cls": pa.array(new[held].astype(np.int32)), "d": pa.array(now[held].astype(np.int32)),
                   "open": pa.array(mine[held]), "active": pa.array((mine | rim | beside[r, c])[held]), "moved": pa.array((mine & rim & ((now != d) | (new != cls)))[held])}
        return _with_keys(key, keys, part, len(held), columns)

    return run


def grow(pixels: DataFrame, keys: tuple[str, ...] = ("batch",), tile: int = TILE) -> DataFrame:
    """(keys, gx, gy, cls, d): pixels with null cls take the class of the nearest pixel that has one, along sides and null pixels only.

    d is the number of steps, 0 for given classes; of equally near classes the largest; null
    pixels that no class reaches get 0. Tiles grow by themselves and pass their rims on until no rim changes, so a
    null area may cross any number of tiles. Classes are positive.
    """
    state = pixels.select(*keys, F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), F.coalesce(F.col("cls").cast("int"), F.lit(0)).alias("cls"), F.when(F.col("cls").isNull(), _NEVER).otherwise(0).cast("int").alias("d"), F.col("cls").isNull().alias("open"))
    kind = _kind(state, keys, "gx long, gy long, cls int, d int, open boolean, active boolean, moved boolean")
    rims = (("gx", 0, -1, 0), ("gx", tile - 1, 1, 0), ("gy", 0, 0, -1), ("gy", tile - 1, 0, 1))
    beyond = (F.when(F.pmod(c, F.lit(tile)) == at, F.struct((F.col("_tx") + a).alias("_tx"), (F.col("_ty") + b).alias("_ty"))) for c, at, a, b in rims)
    tiles = F.array_compact(F.array(F.struct("_tx", "_ty"), *beyond))
    done, old = None, None
    while True:
        sent = _cells(state, tile).select(*keys, "gx", "gy", "cls", "d", "open", F.inline(tiles))
        grown = written(sent.groupBy(*keys, "_tx", "_ty").applyInArrow(_grow(keys, tile), kind), "grown")
        if old is not None:
            remove(old)
        if done is None:  # most pixels have nothing more to do
            done = grown.where("NOT active").select(*keys, "gx", "gy", "cls", "d")
        else:
            old = grown
        state = grown.where("active").drop("active", "moved")
        if not grown.where("moved").limit(1).count():
            return done.unionByName(state.select(*keys, "gx", "gy", "cls", F.when(F.col("cls") == 0, None).otherwise(F.col("d")).alias("d")))


def sieve(pixels: DataFrame, least: int, keys: tuple[str, ...] = ("batch",), tile: int = TILE) -> DataFrame:
    """(keys, gx, gy, cls): regions (corners join) of fewer than `least` pixels take the nearest other class, the largest of equally near ones.

    Small gaps between pixels are crossed but not filled; what no class reaches gets class 0.
    """
    known = _regions(pixels, keys, tile, True, least)
    small = F.col("n") < least
    start = known.where((F.col("cls") > 0) | small).select(*keys, "gx", "gy", F.when(~small, F.col("cls")).alias("cls"), (F.col("cls") > 0).alias("real"))
    start = written(start, "sieve")
    gaps = start.where("NOT real").select(*keys, "gx", "gy")
    return grow(start.drop("real"), keys, tile).drop("d").join(gaps, [*keys, "gx", "gy"], "left_anti")


def fill_map(pixels: DataFrame, objects: int, holes: int, keys: tuple[str, ...] = ("batch",), tile: int = TILE) -> DataFrame:
    """(keys, gx, gy, cls): a class map without regions (corners join) of fewer than `objects` pixels, and with background of fewer than `holes` pixels (sides join) filled.

    Classes grow into the holes along sides, step by step, so a hole is divided by distance; of equally near
    classes the largest. Background within the map's extent counts; where it reaches a tile without pixels it is no hole.
    """
    bounds = written(extent(pixels.where("cls <> 0"), keys), "extent")
    kept = written(_regions(pixels, keys, tile, True).where(F.col("n") >= objects).select(*keys, "gx", "gy", "cls"), "objects")
    back = _regions(kept, keys, tile, False, holes, bounds).where((F.col("cls") == 0) & (F.col("n") < holes))
    start = kept.unionByName(back.select(*keys, "gx", "gy", F.lit(None).cast("int").alias("cls")))
    return grow(start, keys, tile).where("cls <> 0").drop("d")


def _trace(keys: tuple[str, ...], tile: int):
    """One tile with the pixels around it -> (keys, region, closed, xs, ys, first, last): pieces of outlines, cut at the tile's rim.

    A side between a pixel and another region is a step with the pixel on its right: 0 right, 1 down, 2 left,
    3 up. The step after it turns right where it can, else goes on, else turns left.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        tx, ty = (k.as_py() * tile - 1 for k in key[-2:])
        r, c = part["gy"].to_numpy() - ty, part["gx"].to_numpy() - tx
        names, number = np.unique(part["region"].to_numpy(), return_inverse=True)
        image = np.zeros((tile + 2, tile + 2), np.int64)
        image[r, c] = number + 1
        inner = image[1:-1, 1:-1]
        sides = []
        for way, (dr, dc, sr, sc) in enumerate(((-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0))):
            i, j = np.nonzero((inner > 0) & (inner != image[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc]))
            sides.append(np.stack([inner[i, j], i + sr, j + sc, np.full(len(i), way)]))
        region, row, col, way = np.concatenate(sides, axis=1)
        n = len(region)
        code = lambda g, i, j, w: ((g * (tile + 1) + i) * (tile + 1) + j) * 4 + w
        have = code(region, row, col, way)
        order = np.argsort(have)
        region, row, col, way, have = region[order], row[order], col[order], way[order], have[order]
        to_row, to_col = row + np.array([0, 1, 0, -1])[way], col + np.array([1, 0, -1, 0])[way]
        after = np.full(n + 1, n)
        for turn in (3, 0, 1):  # the last that exists counts
            want = code(region, to_row, to_col, (way + turn) % 4)
            at = np.minimum(np.searchsorted(have, want), n - 1)
            after[:n] = np.where(have[at] == want, at, after[:n]) if n else after[:n]
        rim = (to_row == 0) | (to_col == 0) | (to_row == tile) | (to_col == tile)
        after[:n][rim] = n
        hop, least = after.copy(), np.append(np.arange(n), n)
        for _ in range(n.bit_length() + 1):
            least, hop = np.minimum(least, least[hop]), hop[hop]
        round_ = hop[:n] != n
        cut = np.flatnonzero(round_ & (least[:n] == after[:n]))  # the step before a loop's first
        after[cut] = n
        hop, ahead, last = after.copy(), (after != n).astype(np.int64), np.where(after == n, np.arange(n + 1), 0)
        for _ in range(n.bit_length() + 1):
            last = np.where(hop == n, last, last[hop])
            ahead, hop = ahead + ahead[hop], hop[hop]
        order = np.lexsort((-ahead[:n], last[:n]))
        region, row, col, way, last, round_ = region[order], row[order], col[order], way[order], last[:n][order], round_[order]
        head = np.append(True, last[1:] != last[:-1])[:n]
        corner = head | np.append(True, way[1:] != way[:-1])[:n]
        piece = np.cumsum(head) - 1
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], n) - 1 if n else starts
        # each piece: its corners, and its end
        pick = np.concatenate([np.flatnonzero(corner), ends])
        end_row, end_col = row[ends] + np.array([0, 1, 0, -1])[way[ends]], col[ends] + np.array([1, 0, -1, 0])[way[ends]]
        ys, xs = np.concatenate([row[corner], end_row]), np.concatenate([col[corner], end_col])
        of = np.concatenate([piece[corner], np.arange(len(starts))])
        by = np.lexsort((np.arange(len(of)), of))
        cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(starts)))]).astype(np.int32))
        lists = lambda v: pa.ListArray.from_arrays(cuts, pa.array(v[by].astype(np.int64)))
        columns = {"region": pa.array(names[region[starts] - 1]), "closed": pa.array(round_[starts]), "xs": lists(xs + tx + 1), "ys": lists(ys + ty + 1),
                   "first": pa.array(way[starts].astype(np.int32)), "last": pa.array(way[ends].astype(np.int32))}
        return _with_keys(key, keys, part, len(starts), columns)

    return run


def _corners(x: list[int], y: list[int]) -> np.ndarray:
    """A closed way's points without those on a straight line, from the first in scan order."""
    p = np.array([x, y], np.int64).T
    before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
    p = p[before[:, 0] * after[:, 1] != before[:, 1] * after[:, 0]]
    return np.roll(p, -np.lexsort((p[:, 0], p[:, 1]))[0], 0)


def _stitch(keys: tuple[str, ...], size: float):
    """All pieces of one region -> its rings, the outer one first."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        pieces = part.select(["closed", "xs", "ys", "first", "last"]).to_pylist()
        loops = [_corners(p["xs"][:-1], p["ys"][:-1]) for p in pieces if p["closed"]]
        from_: dict[tuple, dict] = {(p["xs"][0], p["ys"][0], p["first"]): p for p in pieces if not p["closed"]}
        while from_:
            p = from_.pop(next(iter(from_)))
            x, y = p["xs"][:-1], p["ys"][:-1]
            while True:
                at = (p["xs"][-1], p["ys"][-1])
                ways = [(*at, (p["last"] + turn) % 4) for turn in (1, 0, 3)]
                p = next((from_.pop(w) for w in ways if w in from_), None)
                if p is None:
                    break
                x += p["xs"][:-1]
                y += p["ys"][:-1]
            loops.append(_corners(x, y))
        area = lambda p: abs(int((p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]).sum()))
        loops.sort(key=lambda p: (-area(p), p[0, 1], p[0, 0]))
        rings = [[{"x": float(a) * size, "y": float(b) * size} for a, b in p] for p in loops]
        return _with_keys(key, keys, part, 1, {"rings": pa.array([rings], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))})

    return run


def outlines(pixels: DataFrame, size: float, keys: tuple[str, ...] = ("batch",), tile: int = TILE) -> DataFrame:
    """(keys, cls, region, rings, area_m): the polygons of a class map, regions joined by sides; rings[0] is the outer ring, the others are holes.

    Tiles trace their pieces of each outline; a piece ends at the tile's rim, and the pieces of
    one region meet to be stitched, so a task holds a tile or the corners of one polygon, never an image.
    """
    known = written(regions(pixels, keys, tile), "regions")
    rims = (("gx", 0, -1, 0), ("gx", tile - 1, 1, 0), ("gy", 0, 0, -1), ("gy", tile - 1, 0, 1))
    beyond = (F.when(F.pmod(c, F.lit(tile)) == at, F.struct((F.col("_tx") + a).alias("_tx"), (F.col("_ty") + b).alias("_ty"))) for c, at, a, b in rims)
    tiles = F.array_compact(F.array(F.struct("_tx", "_ty"), *beyond))
    sent = _cells(known, tile).select(*keys, "gx", "gy", "region", F.inline(tiles))
    pieces = sent.groupBy(*keys, "_tx", "_ty").applyInArrow(_trace(keys, tile), _kind(known, keys, "region long, closed boolean, xs array<long>, ys array<long>, first int, last int"))
    rings = pieces.groupBy(*keys, "region").applyInArrow(_stitch((*keys, "region"), size), _kind(known, keys, f"region long, rings {RINGS}"))
    about = known.groupBy(*keys, "region").agg(F.first("cls").alias("cls"), (F.count("*") * F.lit(size * size)).alias("area_m"))
    return about.join(rings, [*keys, "region"]).select(*keys, "cls", "region", "rings", "area_m")


def simplified(polygons: DataFrame, tolerance: float) -> DataFrame:
    """polygons with rings whose corners within tolerance of the simpler ring are left out; holes that are ever so small stay. Null rings stay null.

    A ring is simplified on its own, so sides that two polygons share may part by up to twice the tolerance.
    """
    at = polygons.columns.index("rings")
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def simpler(rings: list | None) -> list | None:
        return rings and [[{"x": float(a), "y": float(b)} for a, b in kernels.simplify_ring(np.array([(c["x"], c["y"]) for c in g], float).reshape(-1, 2), tolerance)] for g in rings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([simpler(v) for v in batch.column(at).to_pylist()], pa.list_(pa.list_(point)))
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return polygons.mapInArrow(run, polygons.schema)


def banklines(pixels: DataFrame, size: float, keys: tuple[str, ...] = (), tolerance: float = 0.1, tile: int = TILE) -> DataFrame:
    """(keys, region, rings, area_m): the covered water as polygons, from all pixels (keys, gx, gy) with data of all tiles and recordings.

    Pixels are united first, so neighbouring rasters dissolve; then outlines, simplified to
    tolerance. area_m is that of the pixels.
    """
    covered = pixels.select(*keys, "gx", "gy").distinct().withColumn("cls", F.lit(1))
    return simplified(outlines(covered, size, keys, tile).drop("cls"), tolerance)
