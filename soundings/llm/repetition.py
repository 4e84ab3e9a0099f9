"""Quality rules on repetition inside a text, by suffix arrays.

The words of a batch of texts form one sequence; a word's first rank holds its text's
number, so suffixes of different texts never share a prefix. Prefix doubling sorts only the
suffixes that are still tied: of ordinary prose few are after two rounds. Ranks of every round
give the longest common prefix of neighbours in the suffix array, from the longest stride
down. Neighbours whose prefix is at least `least` words lie in an LCP interval, that is a
maximal repeat; each member's place covers that many words, and the union of those spans
is the repeated part of the text. A text is kept if that part and the longest repeat stay
within limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import WHITE, Texts, slices, words

#: Counted as symbols.
SYMBOLS = b"#*$%&|<>"


def suffix_array(rank: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, LCP of each with the one before), in words.

    rank: a number for each word, equal for equal words of a text, different across texts.
    left: how many words remain in the text from each place.
    """
    n = len(rank)
    _, rank = np.unique(rank, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    rank = _as_ranks(order, rank)
    history = [rank]
    h = 1
    while True:
        # places in `order` of suffixes whose rank another one has too
        sorted_rank = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.flatnonzero(same[:n] | same[1:])
        if not len(tied):
            break
        who = order[tied]
        nxt = np.full(len(who), -1, np.int64)
        further = left[who] > h
        nxt[further] = rank[who[further] + h]
        if h > left.max(initial=0):
            break
        by = np.lexsort((nxt, sorted_rank[tied]))
        order[tied] = who[by]
        a, b = sorted_rank[tied][by], nxt[by]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        rank = rank.copy()
        rank[who[by]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        history.append(rank)
        h *= 2
    lcp = np.zeros(n, np.int64)
    i, j = order[1:], order[:-1]
    live = np.flatnonzero(history[0][i] == history[0][j]) if n > 1 else np.zeros(0, np.int64)
    x, y, got = i[live], j[live], np.zeros(len(live), np.int64)
    room = np.minimum(left[x], left[y])
    for k in range(len(history) - 1, -1, -1):
        step = 1 << k
        ok = got + step <= room
        ok[ok] = history[k][x[ok] + got[ok]] == history[k][y[ok] + got[ok]]
        got[ok] += step
    lcp[1:][live] = got
    return order, lcp


def _as_ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each suffix the first place in `order` of its value."""
    v = values[order]
    fresh = np.concatenate([[True], v[1:] != v[:-1]]) if len(v) else np.zeros(0, bool)
    out = np.empty(len(values), np.int64)
    out[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(v)), 0)) if len(v) else 0
    return out


def repeats(first: np.ndarray, hashes: np.ndarray, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words covered by repeats of at least `least` words, the longest repeat, and the number of maximal repeats (LCP intervals)."""
    n_texts, n = len(first) - 1, len(hashes)
    covered, longest, maximal = (np.zeros(n_texts, np.int64) for _ in range(3))
    if not n:
        return covered, longest, maximal
    text = np.repeat(np.arange(n_texts), np.diff(first))
    left = first[1:][text] - np.arange(n)
    _, word = np.unique(hashes, return_inverse=True)
    order, lcp = suffix_array(text * (int(word.max()) + 1) + word, left)
    reach = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    np.maximum.at(longest, text[order], reach)
    long = reach >= least
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, order[long], 1)
    np.add.at(mark, order[long] + reach[long], -1)  # stays inside the text: a prefix of the suffix
    covered += np.bincount(text, weights=np.cumsum(mark[:n]) > 0, minlength=n_texts).astype(np.int64)
    # An interval opens wherever the LCP rises to a new value of at least `least`.
    open_ = np.flatnonzero((lcp >= least) & (lcp > np.concatenate([[0], lcp[:-1]])))
    np.add.at(maximal, text[order[open_]], 1)
    return covered, longest, maximal


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, least: int = 5, most_covered: float = 0.2, most_longest: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, longest_repeat, n_maximal.

    n_repeat_words: words in repeats of at least `least` words (all places, the first
    included). base_failed: under 10 words, or more than a fifth of them repeated. kept: not
    failed, at most most_covered of the words repeated, no repeat longer than most_longest words.

    Null, empty and blank texts have 0 words and so fail; texts of any length are read
    whole; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
    """
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column(1))
                first, s, e, h = words(t)
                n = np.diff(first)
                base = int(t.offsets[0]) if t.n else 0
                data = t.bytes[base : int(t.offsets[-1])] if t.n else t.bytes
                ends = t.offsets - base
                cut = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
                chars, symbols = cut(((data & 0xC0) != 0x80) & ~WHITE[data]), cut(symbol[data])
                dups = np.array([_duplicate_lines(t.text(i)) for i in range(t.n)], np.int64)
                covered, longest, maximal = repeats(first, h, least)
                failed = (n < 10) | (100 * covered > 20 * n)
                kept = ~failed & (covered <= most_covered * n) & (longest <= most_longest)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(np.asarray(x, np.int64)) for x in (n, chars, symbols, dups, covered)), pa.array(failed), pa.array(kept), pa.array(longest), pa.array(maximal)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat", "n_maximal"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, longest_repeat long, n_maximal long",
    )
