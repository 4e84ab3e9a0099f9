"""Maximal runs of wanted bytes in whole texts, as Arrow strings without a loop over them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ._words import _LOWER, Texts


def runs(texts: Texts, wanted: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(text of each run, the runs with A-Z lower-cased), in order; a run ends where its text does.

    wanted: from bytes to a mask that holds either all bytes of a character or none.
    """
    lo, hi = (int(texts.offsets[0]), int(texts.offsets[-1])) if texts.n else (0, 0)
    data, heads = texts.bytes[lo:hi], texts.offsets - lo
    inside = wanted(data)
    cut = np.zeros(len(data) + 1, bool)
    cut[heads] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(e - s)])
    found = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[inside]])])
    return np.searchsorted(heads, s, "right") - 1, found


def letters(data: np.ndarray) -> np.ndarray:
    """A-Z, a-z and every byte of a character beyond ASCII."""
    return LETTERS[data]


def latin(data: np.ndarray) -> np.ndarray:
    """A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and one byte more."""
    lead = data == 0xC3
    out = lead | (LETTERS[data] & (data < 0x80))
    out[1:] |= lead[:-1]
    return out


LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def parts(found: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an array made by runs()."""
    return np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1], np.frombuffer(found.buffers()[2], np.uint8) if len(found) else np.zeros(0, np.uint8)
