"""Near-duplicate documents by HyperMinHash with banding.

Every distinct shingle hash goes to one of 256 buckets by its first 8 bits. A bucket keeps
the smallest of the remaining 56 bits, compressed to 16: the count of leading zeros and the
8 bits after the leading one. Buckets that a short text leaves empty borrow the register of
another bucket, found along an order drawn per bucket (densification), so texts of any
length have a full signature whose registers agree with probability J, the Jaccard index.

1. Texts with equal shingle sets become one class (their link is certain); a class, not a
   doc_id, is what links join, so a doc_id may name several texts.
2. 42 bands of 6 registers: a pair with J = 0.8 shares no band with probability 3e-6.
3. Within a band's bucket every class is paired with the smallest one: a star, not all pairs.
4. Pairs are dropped if their sizes rule out the threshold, or if the collision-corrected
   estimate of J lies five standard errors below it; the rest are verified on full sets.
5. Components of verified links. Where a bucket holds classes of several components, links
   between those are still open. Such classes meet in the family of the bucket's largest
   component: those outside that component with each other and with it, never its own
   members. A family is cut into cells of set size, of which only neighbours can link, and
   cells into tiles of bounded size. A first pass over pairs of tiles compares registers and
   names the classes that some estimate leaves open; only their sets go to a second pass,
   which counts shared shingles in matrices and returns a spanning forest of the links. So
   a large group of near copies costs about one pair per member, and the proof that its
   outliers are not linked to it takes place inside tasks, mostly on registers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._shared import remove, written
from ._words import U, Texts, mix, shingles, slices, words

BUCKETS, MANTISSA, ROWS, BANDS = 256, 8, 6, 42
ERRORS = 5.0
TILE_SHINGLES, TILE_SETS = 1_000_000, 1024
#: Candidates up to which a bitmap of 16 bits each (8 MB) finds their texts; beyond, texts meet them in a join.
BITMAP_IDS = (1 << 22) - 1
_rng = np.random.Generator(np.random.PCG64(7))
_ORDER = np.argsort(_rng.random((BUCKETS, BUCKETS)), axis=1)
_BAND_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)


def registers(u: np.ndarray) -> np.ndarray:
    """The 256 registers (uint16: leading zeros, then mantissa) of a sorted distinct set of hashes."""
    bucket = (u >> U(56)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = u[head] & U((1 << 56) - 1)
    m, e = np.frexp(rest.astype(np.float64))  # the smallest of each bucket is the first
    zeros = (56 - e).astype(np.int64)
    code = (zeros << MANTISSA) | np.minimum(((m - 0.5) * 2 * (1 << MANTISSA)).astype(np.int64), (1 << MANTISSA) - 1).clip(0)
    out = np.zeros(BUCKETS, np.uint16)
    full = np.zeros(BUCKETS, bool)
    out[bucket[head]], full[bucket[head]] = code, True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _ORDER[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def bands(r: np.ndarray) -> np.ndarray:
    x = _BAND_SALT.copy()
    parts = r[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            x = mix(x + parts[:, j] * U(0x9E3779B97F4A7C15) + U(j))
    return x


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """J of pairs of rows of registers, from the share of equal ones, less what registers of unrelated minima agree by chance.

    Minima in a bucket are near exponential with rates na and nb; a register holds them to
    a relative width of 0.7213 / 2**MANTISSA on average, so unrelated ones agree with
    probability 0.7213 / 2**MANTISSA * na * nb / (na + nb)**2.
    """
    chance = 0.7213 / (1 << MANTISSA) * na * nb / (na + nb) ** 2
    return ((a == b).mean(axis=-1) - chance) / (1 - chance)


def open_pairs(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and estimate leave num/den possible, for pairs of rows (or one row and many)."""
    na, nb = na.astype(np.float64), nb.astype(np.float64)
    t, seen = num / den, np.minimum(BUCKETS, np.maximum(na, nb))
    sized = np.minimum(na, nb) * den >= np.maximum(na, nb) * num
    return sized & (estimate(a, b, na, nb) >= t - ERRORS * (t * (1 - t) / seen) ** 0.5)


def _stack(column: pa.Array) -> np.ndarray:
    """A binary column of registers as a matrix."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16).reshape(-1, BUCKETS) if len(column) else np.zeros((0, BUCKETS), np.uint16)


def _prints(u: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The two halves of a set's 128-bit fingerprint."""
    with np.errstate(over="ignore"):
        return u.sum(), mix(u + U(1)).sum()


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, h (the hash of the text), n (set size), f and g (a 128-bit fingerprint of the set), bands; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = Texts(part.column(1))
                first, _, _, h = words(texts, lower=True)
                size, f, g = np.zeros(texts.n, np.int64), np.zeros(texts.n, U), np.zeros(texts.n, U)
                keys = []
                for i, u in enumerate(shingles(first, h, n)):
                    size[i] = len(u)
                    if len(u):
                        f[i], g[i] = _prints(u)
                        keys.append(bands(registers(u)))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(size), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    ["doc_id", "h", "n", "f", "g", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, n long, f long, g long, bands array<long>")


def sets(docs: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """f, g, n, set (the sorted distinct shingle hashes), regs: of the texts whose key (doc_id, else the hash of the text) is in keys (k), and a few others.

    A bitmap of hashed keys lets tasks skip most other texts where they are read, so neither
    texts nor sets are shuffled here; beyond BITMAP_IDS keys it would let too many through,
    and texts are joined with the keys instead.
    """
    k = F.coalesce("doc_id", F.xxhash64("text"))
    count = keys.count()
    if count > BITMAP_IDS:
        wanted, held = docs.select("text", k.alias("k")).join(keys, "k", "left_semi").select("text"), None
    else:
        bits = 1 << max(16, (16 * count).bit_length())
        spot = F.pmod(F.xxhash64("k"), F.lit(bits))
        words_ = keys.select((spot / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(k), 64) as int))").alias("bit")).groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
        table = np.zeros(bits // 64, np.int64)
        table[words_["at"]] = words_["bits"]
        held = docs.sparkSession.sparkContext.broadcast(table.view(np.uint8))
        wanted = docs.select("text", k.alias("k")).select("text", spot.alias("spot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                at = np.asarray(batch.column(1)).astype(np.int64)
                batch = batch.filter(pa.array((held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(batch, column=0):
                first, _, _, h = words(Texts(part.column(0)), lower=True)
                each = [u for u in shingles(first, h, n) if len(u)]
                ends = np.concatenate([[0], np.cumsum([len(u) for u in each])]).astype(np.int32)
                flat = np.concatenate(each).view(np.int64) if each else np.zeros(0, np.int64)
                f, g = (np.array(x, U).view(np.int64) for x in (zip(*map(_prints, each)) if each else ([], [])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f), pa.array(g), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([registers(u).tobytes() for u in each], pa.binary())],
                    ["f", "g", "n", "set", "regs"],
                )

    made = written(wanted.mapInArrow(run, "f long, g long, n long, set array<long>, regs binary"), "near-sets")
    if made.groupBy("f", "g").count().where("count > 1").isEmpty():
        return made
    once = written(made.groupBy("f", "g", "n").agg(F.first("set").alias("set"), F.first("regs").alias("regs")), "near-sets")
    remove(made)
    return once


def _named(full: DataFrame, side: str, *columns: str) -> DataFrame:
    """f, g and some columns of the sets, each with `side` behind its name."""
    return full.select(*(F.col(c).alias(c + side) for c in ("f", "g", *columns)))


def _promising(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v, fu, gu, fv, gv) whose sizes and estimate allow num/den."""
    sized = pairs.join(_named(full, "u", "n", "regs"), ["fu", "gu"]).join(_named(full, "v", "n", "regs"), ["fv", "gv"]).where(F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num)
    names = ["u", "v", "fu", "gu", "fv", "gv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array(open_pairs(_stack(b.column("regsu")), _stack(b.column("regsv")), np.asarray(b.column("nu")), np.asarray(b.column("nv")), num, den))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in names], names)

    return sized.select(*names, "nu", "nv", "regsu", "regsv").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _verified(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets satisfy den * |intersection| >= num * |union|."""
    both = F.size(F.array_intersect("setu", "setv"))
    held = pairs.join(_named(full, "u", "set"), ["fu", "gu"]).join(_named(full, "v", "set"), ["fv", "gv"])
    return written(held.where(den * both >= num * (F.size("setu") + F.size("setv") - both)).select("u", "v"), "near-links")


def _shared_counts(sets_: list[np.ndarray]) -> np.ndarray:
    """n by n counts of shingles that sets share: pairs of documents for rare shingles, matrix products for common ones."""
    n = len(sets_)
    doc = np.repeat(np.arange(n), [len(x) for x in sets_])
    _, token, df = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    order = np.argsort(token, kind="stable")
    doc, start = doc[order], np.concatenate([[0], np.cumsum(df)])[:-1]
    out = np.zeros(n * n, np.float32)
    for d in range(2, 17):
        at = start[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                np.add.at(out, doc[at + i] * n + doc[at + j], 1)
    out = out.reshape(n, n)
    out += out.T
    common = np.flatnonzero(df > 16)
    for k in range(0, len(common), 4096):
        some = common[k : k + 4096]
        x = np.zeros((n, len(some)), np.float32)
        for c, t in enumerate(some):
            x[doc[start[t] : start[t] + df[t]], c] = 1
        out += x @ x.T
    return out


#: What names a task of _across: a cell of a family, the distance of the other cell (0 or 1), and a tile of each.
TASK = ("family", "cell", "far", "ta", "tb")


def _dealt(open_: DataFrame, num: int, den: int) -> DataFrame:
    """open_ (id, root, family, f, g, n, ...) with TASK and second (whether in the second tile): a row for each task that a class belongs to.

    Cells are powers of a little over den / num, so sets whose sizes allow a link are in one
    cell or in neighbours. A cell's tiles of outsiders come first, those of the family's own
    component after them; no task joins two of the latter.
    """
    base = den / num * (1 + 1e-6)
    placed = open_.withColumns({"cell": F.floor(F.log(F.col("n").cast("double")) / math.log(base)).cast("int"), "own": F.col("root") == F.col("family")})
    tiles = F.greatest(F.ceil(F.sum("n") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_SETS)).cast("int")
    counts = placed.groupBy("family", "cell", "own").agg(tiles.alias("tiles"))
    cells = counts.groupBy("family", "cell").agg(*(F.coalesce(F.max(F.when(F.col("own") == own, F.col("tiles"))), F.lit(0)).alias(name) for own, name in ((False, "guests"), (True, "owns"))))
    after = cells.select("family", (F.col("cell") - 1).alias("cell"), F.col("guests").alias("guests_up"), F.col("owns").alias("owns_up"))
    before = cells.select("family", (F.col("cell") + 1).alias("cell"), F.col("guests").alias("guests_down"), F.col("owns").alias("owns_down"))
    around = cells.join(after, ["family", "cell"], "left").join(before, ["family", "cell"], "left").fillna(0)
    each = placed.join(around, ["family", "cell"]).withColumn("tile", F.when(F.col("own"), F.col("guests") + F.pmod(F.xxhash64("id"), F.col("owns"))).otherwise(F.pmod(F.xxhash64("id"), F.col("guests"))).cast("int"))

    def met(where: str) -> Column:
        """The other cell's tiles: all for outsiders, the outsiders' for others."""
        n = F.col("guests" + where) + F.when(F.col("own"), 0).otherwise(F.col("owns" + where))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def task(cell: Column, far: int, a: Column, b: Column, second: Column) -> Column:
        return F.struct(cell.cast("int").alias("cell"), F.lit(far).alias("far"), a.alias("ta"), b.alias("tb"), second.alias("second"))

    cell, tile, no, yes = F.col("cell"), F.col("tile"), F.lit(False), F.lit(True)
    tasks = F.concat(
        F.transform(met(""), lambda o: task(cell, 0, F.least(tile, o), F.greatest(tile, o), tile > o)),
        F.transform(met("_up"), lambda o: task(cell, 1, tile, o, no)),
        F.transform(met("_down"), lambda o: task(cell - 1, 1, o, tile, yes)),
    )
    return each.select(*open_.columns, F.explode(tasks).alias("task")).select(*open_.columns, "task.*")


def _across(open_: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) between components within families; open_: (id, root, family, f, g, n)."""

    def sift(key: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        root, size, second = (part.column(c).to_numpy() for c in ("root", "n", "second"))
        regs = _stack(part.column("regs").chunk(0))
        one = np.flatnonzero(~second)
        two = one if key[2].as_py() == 0 and key[3] == key[4] else np.flatnonzero(second)
        open_to = np.zeros(len(root), bool)
        for i in one:
            near = two[(root[two] != root[i]) & (np.minimum(size[two], size[i]) * den >= np.maximum(size[two], size[i]) * num)]
            if len(near):
                near = near[open_pairs(regs[i], regs[near], size[i], size[near], num, den)]
                open_to[near] = True
                open_to[i] |= len(near) > 0
        return part.filter(pa.array(open_to)).select(["id", "root", "f", "g", *TASK])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids, roots = part["id"].to_numpy(), part["root"].to_numpy()
        sets_ = [np.asarray(x, np.int64) for x in part["set"]]
        size = np.array([len(x) for x in sets_], np.float64)
        both = _shared_counts(sets_).astype(np.float64)
        near = den * both >= num * (size[:, None] + size[None] - both)
        near &= (ids[:, None] < ids[None]) & (roots[:, None] != roots[None])
        return _forest(ids, *np.nonzero(near))

    kinds = "cell int, far int, ta int, tb int"
    lean = _dealt(open_, num, den).join(full.select("f", "g", "regs"), ["f", "g"]).select("id", "root", "n", "f", "g", "regs", "second", *TASK)
    left = written(lean.groupBy(*TASK).applyInArrow(sift, f"id long, root long, f long, g long, family long, {kinds}"), "near-open")
    return written(left.join(full.select("f", "g", "set"), ["f", "g"]).select("id", "root", "set", *TASK).groupBy(*TASK).applyInPandas(run, "u long, v long"), "near-across")


def _forest(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """A spanning forest of the links a-b (positions in ids)."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = root(i), root(j)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((ids[i], ids[j]))
    return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)


def groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    A document's set: the distinct n-word shingles of its text with A-Z lower-cased; of fewer
    words the whole sequence. Links: den * intersection >= num * union. component_id is the
    smallest doc_id reachable, kept whether that is the row's own.

    Null, empty and blank texts have no set and link with nothing. Rows with a null doc_id
    are linked by text like others but never name a component; they are kept, and where no row
    of their component has an id they get a null one. Repeated rows share their doc_id and so
    are all kept or all dropped. Where a doc_id names several texts, each is linked by itself,
    and of those of one component one is kept. An empty table gives no rows; other columns
    are ignored.
    """
    return _judged(docs, n, num, den).drop("h")


def _judged(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """groups() with h, the hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = written(signatures(docs, n).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    light = sigs.select("doc_id", "h", "n", "f", "g", "row")
    # A class is named by one of its rows, numbered as they were written.
    classes = written(light.where("n > 0").groupBy("f", "g", "n").agg(F.min("row").alias("id"), F.min("doc_id").alias("rep"), F.min("h").alias("h")), "near-classes")
    keyed = written(sigs.join(classes.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), F.explode("bands").alias("key")), "near-keys")
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    shared = written(keyed.join(hubs, "key"), "near-shared")
    remove(keyed)
    of = lambda c: classes.select(F.col("id").alias(c), F.col("f").alias(f"f{c}"), F.col("g").alias(f"g{c}"))
    star = shared.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct()
    star = written(star.join(of("u"), "u").join(of("v"), "v"), "near-star")
    met = star.select(F.col("u").alias("id")).union(star.select("v")).distinct()
    full = sets(docs, classes.join(met, "id", "left_semi").select(F.coalesce("rep", "h").alias("k")).distinct(), n)
    pairs = written(_promising(star, full, num, den), "near-pairs")
    remove(star)
    links = _verified(pairs, full, num, den)
    remove(pairs)
    root = components(links, "near")
    at = shared.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    mains = at.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.min_by("root", F.struct(-F.col("k"), F.col("root"))).alias("family"), F.count("*").alias("roots")).where("roots > 1")
    open_ = written(at.join(mains, "key").select("id", "root", "family").distinct().join(classes.select("id", "f", "g", "n"), "id"), "near-open")
    remove(shared)
    more = _across(open_, full, num, den)
    remove(full)
    if not more.isEmpty():
        root = components(links.unionByName(more), "near")
    member = classes.join(root, "id", "left").select("f", "g", F.col("n").alias("m"), "rep", F.coalesce("root", "id").alias("root"))
    heads = member.where("rep IS NOT NULL").groupBy("root").agg(F.min(F.struct("rep", "f", "g")).alias("head"))
    named = member.join(heads, "root", "left").select(F.col("f").alias("nf"), F.col("g").alias("ng"), "m", F.col("head.rep").alias("component"), ((F.col("f") == F.col("head.f")) & (F.col("g") == F.col("head.g"))).alias("chosen"))
    out = light.join(named, (light.f == named.nf) & (light.g == named.ng) & (light.n == named.m), "left")
    component = F.coalesce("component", "doc_id")
    kept = F.when(F.col("doc_id").isNotNull(), (component == F.col("doc_id")) & F.coalesce("chosen", F.lit(True)))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, with one document of each group of near copies (the one with the smallest doc_id; where that names several of its texts, one of them).

    Of rows that repeat both doc_id and text one stays. Texts without shingles stay under each id; rows with a null doc_id all stay.
    """
    drop = _judged(docs, n, num, den).where("NOT kept").select(F.col("doc_id").alias("near_dropped"), "h").distinct()
    left = docs.join(drop, (docs["doc_id"].cast("long") == drop["near_dropped"]) & (F.xxhash64(docs["text"]) == drop["h"]), "left_anti")
    again = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("doc_id").alias("near_again")), "near-again")
    if again.isEmpty():
        return left
    many = left.join(again, left["doc_id"] == again["near_again"], "left_semi")
    return left.join(again, left["doc_id"] == again["near_again"], "left_anti").unionByName(many.dropDuplicates(["doc_id", "text"]))
