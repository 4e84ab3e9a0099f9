"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

1. Words are counted over whole texts, added up within a task's slices before the shuffle.
2. Each word yields an integer key for the word itself and for the word without each of its code
   points: polynomial hashes of the prefix and the suffix around the place, put together modulo 2**64.
   Equal strings have equal keys, so u and v are near exactly if u without a point is v, or
   if both without their points at the same place are one string.
3. Keys are partitioned by their leading bits and sorted by Spark. A task walks the sorted
   keys; candidates within a key are confirmed on the shortened strings themselves.
4. Both ends of a link count it; each word takes its most frequent neighbour as its form if that is ten
   times as frequent. Forms are followed by doubling: a chain is at most as long as the
   number of digits of the largest count.

The words of one key differ in one place or lack it, so a key's group is bounded by the
alphabet times the word's length, however large the corpus is.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._terms import latin, parts, runs
from ._words import LONG, Texts, mix, slices

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
EVERY = 31


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> 1), t >> 1).astype(np.uint32)
    return t


CRC = _crc_table()


def crc32(start: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """crc32 of data[ends[i]:ends[i + 1]], each continued from start[i]."""
    state, at, left = ~start.astype(np.uint32), ends[:-1].copy(), np.diff(ends)
    live = np.flatnonzero((left > 0) & (left <= LONG))
    while len(live):
        x = state[live]
        state[live] = CRC[(x ^ data[at[live]]) & np.uint32(255)] ^ (x >> np.uint32(8))
        at[live] += 1
        left[live] -= 1
        live = live[left[live] > 0]
    out = ~state
    for i in np.flatnonzero(np.diff(ends) > LONG):
        out[i] = zlib.crc32(data[ends[i] : ends[i + 1]].tobytes(), int(start[i]))
    return out


def _count(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1 << 21):
                which, found = runs(Texts(part.column(1)), latin)
                ends, data = parts(found)
                length = np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends])
                long = length >= least
                which, found, length = which[long], found.filter(pa.array(long)), length[long]
                ends, data = parts(found)
                ids = [zlib.crc32(f"{x}:".encode()) for x in part.column(0).fill_null("").to_pylist()]
                crc = crc32(np.array(ids, np.uint32)[which], ends, data)
                hit = crc % EVERY == 0
                words = [found.filter(pa.array(~hit))]
                cut = []
                for i in np.flatnonzero(hit & (length > least)):
                    word, k = data[ends[i] : ends[i + 1]].tobytes().decode(), int(crc[i]) % int(length[i])
                    cut.append((word[:k] + word[k + 1 :]).encode())
                words.append(pa.array(cut, pa.large_binary()))
                counted = pc.value_counts(pa.concat_arrays(words))
                yield pa.RecordBatch.from_arrays([counted.field(0).cast(pa.binary()).cast(pa.string()), counted.field(1)], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """word, n: runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least `least` code points, that occur at least `times` times.

    Where 31 divides the crc32 of `<doc_id>:<run>`, the run's code point at crc32 modulo its length is left out first.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL")
    return rows.mapInArrow(_count(least), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the words and the total, their code points)."""
    held = words.to_pylist()
    points = np.frombuffer("".join(held).encode("utf-32-le"), np.uint32)
    return np.concatenate([[0], np.cumsum([len(w) for w in held])]).astype(np.int64), points


def deletion_keys(starts: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of each whole word, key of each word without the code point at each place)."""
    n = np.diff(starts)
    place = np.arange(len(points)) - np.repeat(starts[:-1], n)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[U(1)], np.full(int(n.max(initial=0)), BASE)]))
        worth = mix(points.astype(U) + U(1)) * powers[place]
        total = np.concatenate([[U(0)], np.cumsum(worth, dtype=U)])
        before = np.repeat(total[starts[:-1]], n)
        whole = total[starts[1:]] - total[starts[:-1]]
        prefix = total[:-1] - before
        suffix = np.repeat(whole, n) - prefix - worth
        return mix(whole), mix(prefix + suffix * BACK)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, name, n) -> (key, place, fresh, name, n): place -1 for the whole word; fresh unless the code point left out equals the one before."""
    for batch in batches:
        for part in slices(batch, 1 << 16, 0):
            starts, points = _points(part.column(0))
            size = np.diff(starts)
            whole, less = deletion_keys(starts, points)
            place = np.arange(len(points)) - np.repeat(starts[:-1], size)
            fresh = np.ones(len(points), bool)
            fresh[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
            row = np.concatenate([np.arange(len(size)), np.repeat(np.arange(len(size)), size)])
            take = part.select(["name", "n"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([whole, less]).view(np.int64)), pa.array(np.concatenate([np.full(len(size), -1), place]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(size), bool), fresh])), *take.columns],
                ["key", "place", "fresh", "name", "n"],
            )


def _candidates(key: np.ndarray, place: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, sorted by (key, place): a whole word with each fresh shortened one of its key; rows of one key and place."""
    head = np.concatenate([[True], key[1:] != key[:-1]])
    end = np.append(np.flatnonzero(head)[1:], len(key))[np.cumsum(head) - 1]
    a = np.flatnonzero(place < 0)
    span = end[a] - a - 1
    left = np.repeat(a, span)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(span) - span, span)
    left, right = left[fresh[right]], right[fresh[right]]
    lefts, rights = [left], [right]
    same = np.flatnonzero((key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0))
    step = 1
    while len(same):  # at most as often as a group of one place has members
        lefts.append(same)
        rights.append(same + step)
        step += 1
        same = same[same + step < len(key)]
        same = same[(key[same] == key[same + step]) & (place[same] == place[same + step])]
    return np.concatenate(lefts), np.concatenate(rights)


def _shortened(words: pa.Array, place: np.ndarray) -> pa.Array:
    """The words without the code point at place, where that is not -1, as binary."""
    starts, points = _points(words)
    gone = place >= 0
    keep = np.ones(len(points), bool)
    keep[starts[:-1][gone] + place[gone]] = False
    ends = np.concatenate([[0], np.cumsum(np.diff(starts) - gone)]) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(points[keep])])


def _keyed(batches: Iterator[pa.RecordBatch], use: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """use() of rows sorted by key, no key divided: the last key of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        split = int(np.searchsorted(key, key[-1], "left"))
        if split:
            yield use(pa.Table.from_batches([*held, batch.slice(0, split)]))
            held = []
        elif held and held[-1].column(0)[0].as_py() != int(key[0]):
            yield use(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(split))
    if held:
        yield use(pa.Table.from_batches(held))


def _rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t["key"].to_numpy(), t["place"].to_numpy().astype(np.int64), t["fresh"].to_numpy()


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys whose names are the words -> (word, near, n): both directions of each link."""

    def links(t: pa.Table) -> pa.RecordBatch:
        x, y = _candidates(*_rows(t))
        used, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        few = t.take(pa.array(used)).combine_chunks()
        words = few["name"].chunk(0) if len(few) else pa.array([], pa.string())
        short = _shortened(words, few["place"].to_numpy())
        x, y = at[: len(x)], at[len(x) :]
        true = pc.equal(short.take(pa.array(x)), short.take(pa.array(y))).to_numpy(zero_copy_only=False)
        true &= pc.not_equal(words.take(pa.array(x)), words.take(pa.array(y))).to_numpy(zero_copy_only=False)
        x, y = x[true], y[true]
        a, b = pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x]))
        return pa.RecordBatch.from_arrays([words.take(a), words.take(b), few["n"].take(b).combine_chunks()], ["word", "near", "n"])

    return _keyed(batches, links)


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys whose names are numbers -> (a, b, place_a, place_b): unconfirmed candidates."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        x, y = _candidates(*_rows(t))
        return pa.RecordBatch.from_arrays([t[c].take(pa.array(i)).combine_chunks() for c, i in (("name", x), ("name", y), ("place", x), ("place", y))], ["a", "b", "place_a", "place_b"])

    return _keyed(batches, pairs)


def _dealt(words: DataFrame, kind: str) -> DataFrame:
    keys = words.select("word", "name", "n").mapInArrow(_spread, f"key long, place int, fresh boolean, name {kind}, n long")
    return keys.repartition(F.shiftrightunsigned("key", 44)).sortWithinPartitions("key", "place")


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """(word, n) with distinct words -> word, near, n (of near): a row for each ordered pair that differs by one inserted, deleted or replaced code point.

    Keys carry the word. From `long` code points on they carry a number instead, so that a word
    of any length takes memory in proportion to it; their candidates are joined with the words to be confirmed.
    """
    size = F.length("word")
    short = _dealt(words.where(size <= long).withColumn("name", F.col("word")), "string").mapInArrow(_link, "word string, near string, n long")
    far = written(words.where(size >= long).withColumn("name", F.monotonically_increasing_id()), "spell-long")
    met = _dealt(far, "long").mapInArrow(_pair, "a long, b long, place_a int, place_b int")
    side = lambda s: far.select(F.col("name").alias(s), F.col("word").alias(f"word_{s}"), F.col("n").alias(f"n_{s}"))
    less = lambda s: F.when(F.col(f"place_{s}") < 0, F.col(f"word_{s}")).otherwise(F.concat(F.expr(f"substring(word_{s}, 1, place_{s})"), F.expr(f"substring(word_{s}, place_{s} + 2)")))
    true = (less("a") == less("b")) & (F.col("word_a") != F.col("word_b")) & (F.greatest(F.length("word_a"), F.length("word_b")) > long)
    true = met.join(side("a"), "a").join(side("b"), "b").where(true)
    both = F.inline(F.array(*(F.struct(F.col(f"word_{x}").alias("word"), F.col(f"word_{y}").alias("near"), F.col(f"n_{y}").alias("n")) for x, y in ("ab", "ba"))))
    return short.unionByName(true.select(both))


def group(docs: DataFrame, least: int = 7, times: int = 2, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of vocabulary().

    n_near: words one code point away; form: the most frequent of them (ties: the first in
    code-point order) if it occurs at least `factor` times as often, else null, with form_n
    its count; root: where forms lead to, the word itself without one.

    Null and empty texts have no words; a null doc_id counts as an empty one in the crc32;
    repeated rows count each; texts and words of any length are read whole; an empty table
    gives no rows; other columns are ignored.
    """
    words = written(vocabulary(docs, least, times), "spell-words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    form_n = F.when(-F.col("best.n") >= factor * F.col("n"), -F.col("best.n"))
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.near")).alias("form"))
    near = written(near, "spell-near")
    ends = _ends(near.where("form IS NOT NULL").select("word", F.col("form").alias("root")), near, times, factor)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(hops: DataFrame, near: DataFrame, times: int, factor: int) -> DataFrame:
    """(word, root) with each root followed to the last. n grows by factor with every form, which bounds the length of a chain."""
    most = near.agg(F.max("n")).first()[0] or times
    longest = int(math.log(max(most / times, 1), factor) + 1e-9) + 1
    for _ in range(math.ceil(math.log2(longest))):
        further = hops.select(F.col("word").alias("root"), F.col("root").alias("last"))
        hops = written(hops.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "spell-roots")
    return hops
