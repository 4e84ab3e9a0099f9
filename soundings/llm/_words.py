"""Word boundaries, word hashes and shingle sets of whole texts, on Arrow buffers with numpy.

Texts are read in blocks of a few megabytes that end between words, so a text of any length
takes memory for its words (24 bytes each) and one block. Separators are ASCII bytes, which
never occur inside a UTF-8 sequence, so bytes and code points agree on word boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK, SLICE = 1 << 20, 4 << 20
U = np.uint64
LONG = 256  # longer words are hashed one by one
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words b[s:e]: each takes in 8 bytes after another through a bijection, its length first.

    For words of one length and all but one of their chunks equal there is no collision; others
    collide by chance only, whatever their pattern.
    """
    n = e - s
    with np.errstate(over="ignore"):
        h = mix((n.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(b) + 1,), np.dtype("<u8"), padded, strides=(1,))
    live = np.flatnonzero(n <= LONG)
    at, left, x = s[live], n[live], h[live]
    while len(live):
        chunk = eight[at]
        end = left < 8
        chunk[end] &= (U(1) << (left[end] * 8).astype(U)) - U(1)
        x = mix(x ^ chunk)
        h[live] = x
        more = left > 8
        live, at, left, x = live[more], at[more] + 8, left[more] - 8, x[more]
    for i in np.flatnonzero(n > LONG):
        h[i] = int.from_bytes(blake2b(b[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


class Texts:
    """The UTF-8 bytes of a string column; nulls are empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):  # no chunks
            column = pa.array([], pa.string())
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = column.buffers()[2] if len(column) else None
        self.bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.offsets = offsets
        self.n = len(column)

    def text(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def words(texts: Texts, separator: np.ndarray = WHITE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each text and the total: n + 1 numbers, starts, ends, 64-bit hashes); starts and ends are bytes."""
    table = _LOWER if lower else _SAME
    lo, hi = (int(texts.offsets[0]), int(texts.offsets[-1])) if texts.n else (0, 0)
    heads = np.unique(texts.offsets[:-1]) if texts.n else np.zeros(0, np.int64)
    starts, ends, hashes = [], [], []
    at = lo
    while at < hi:
        to = min(hi, at + BLOCK)
        while to < hi:
            cut = np.flatnonzero(separator[texts.bytes[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
                break
            h = np.searchsorted(heads, to, "right") - 1
            if h >= 0 and heads[h] > at:
                to = int(heads[h])
                break
            to = min(hi, to + BLOCK)
        b = texts.bytes[at:to]
        word = ~separator[b]
        edge = np.empty(len(b) + 1, np.int8)
        edge[0], edge[-1] = word[0], -word[-1].astype(np.int8)
        edge[1:-1] = word[1:].astype(np.int8) - word[:-1]
        first, last = np.searchsorted(heads, [at + 1, to])
        inner = heads[first:last] - at
        inner = inner[word[inner] & word[inner - 1]]  # words that touch across texts
        s = np.flatnonzero(edge > 0)
        e = np.flatnonzero(edge < 0)
        if len(inner):
            s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
        h = _hashes(table[b] if lower else b, s, e)
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = join(starts, np.int64)
    return np.searchsorted(s, texts.offsets), s, join(ends, np.int64), join(hashes, U)


def shingles(first: np.ndarray, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles; of fewer words, one of the whole; of none, nothing."""
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - n + 1), U)
        for j in range(n):
            rolled = rolled * U(0x9E3779B97F4A7C15) + hashes[j : j + len(rolled)]
        rolled = mix(rolled + U(n))
        for a, b in zip(first[:-1], first[1:]):
            k = b - a
            if k >= n:
                out = rolled[a : b - n + 1].copy()
                out.sort()
                keep = np.empty(len(out), bool)
                keep[0] = True
                np.not_equal(out[1:], out[:-1], out=keep[1:])
                yield out[keep]
            elif k:
                x = U(0)
                for h in hashes[a:b]:
                    x = x * U(0x9E3779B97F4A7C15) + h
                yield mix(np.array([x + U(1000 + k)], U))
            else:
                yield np.zeros(0, U)


def slices(batch: pa.RecordBatch, most_bytes: int = SLICE, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about most_bytes of text each."""
    offsets = Texts(batch.column(column)).offsets
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
