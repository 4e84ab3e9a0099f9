"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into segments of SEGMENT bytes, the last one padded. One gated
recurrent layer reads each segment forwards and one backwards; from both states every
position gets a probability for each language. A document's probabilities are the mean over
all its positions, its language the largest. Many segments go through each step at once,
so a text of any length is read whole with memory for one batch of segments.

    z, r = 1/2 + 1/2 tanh(T[byte] + U h)        n = tanh(T[byte] + r * (U h + b))        h = h + z * (n - h)

A padded place has z = 0, so it leaves the state as it was. Training minimises the cross
entropy of every position by backpropagation through time over the segment (Adam, fixed seed).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written
from ._words import Texts, slices

HIDDEN, SEGMENT, PAD = 8, 64, 256
BATCH = 2048
#: Bounds of the training sample: documents of each language, and code points of each, taken from a place that its hash says.
PER_LANGUAGE, WINDOW = 400, 640
#: Up to so many languages their counts are sent to every task, else joined.
MOST_BROADCAST = 100_000


class Network(NamedTuple):
    langs: list[str]
    table: np.ndarray  # direction, 3 * hidden (update, reset, new), byte
    inner: np.ndarray  # direction, 3 * hidden, hidden
    bias: np.ndarray  # direction, hidden, 1
    out: np.ndarray  # language, 2 * hidden
    shift: np.ndarray  # language, 1


def blank(langs: list[str], hidden: int = HIDDEN, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((2, 3 * hidden, PAD + 1)) * 0.4
    table[:, :hidden, PAD] = -1e4
    inner = rng.standard_normal((2, 3 * hidden, hidden)) / hidden**0.5
    out = rng.standard_normal((len(langs), 2 * hidden)) / (2 * hidden) ** 0.5
    return Network(langs, *(a.astype(np.float32) for a in (table, inner, np.zeros((2, hidden, 1)), out, np.zeros((len(langs), 1)))))


def segments(data: np.ndarray, ends: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each segment, its length, its text) for texts data[ends[i]:ends[i + 1]]."""
    count = -(-np.diff(ends) // size)
    text = np.repeat(np.arange(len(count)), count)
    start = ends[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * size
    return start, np.minimum(ends[1:][text] - start, size), text


def _bytes(data: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """(size, segments): the bytes of segments, PAD beyond their length."""
    place = np.arange(size)[:, None]
    x = data[np.minimum(start + place, len(data) - 1)].astype(np.int64)
    x[place >= length] = PAD
    return x


def _run(net: Network, way: int, x: np.ndarray) -> np.ndarray:
    """States of one direction after each position: (size, hidden, segments)."""
    table, inner, bias = net.table[way], net.inner[way], net.bias[way]
    k, n = table.shape[0] // 3, x.shape[1]
    states = np.zeros((len(x), k, n), table.dtype)
    h = np.zeros((k, n), table.dtype)
    g, u, d = np.empty((3 * k, n), table.dtype), np.empty((3 * k, n), table.dtype), np.empty((k, n), table.dtype)
    for t in range(len(x)) if way == 0 else range(len(x) - 1, -1, -1):
        np.take(table, x[t], axis=1, out=g, mode="clip")
        np.matmul(inner, h, out=u)
        zr, new = g[: 2 * k], g[2 * k :]
        zr += u[: 2 * k]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.add(u[2 * k :], bias, out=d)
        d *= zr[k:]
        new += d
        np.tanh(new, out=new)
        new -= h
        new *= zr[:k]
        np.add(h, new, out=states[t])
        h = states[t]
    return states


def positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Probabilities of each language at each position: (size, language, segments)."""
    k = net.inner.shape[2]
    p = np.matmul(net.out[:, :k], _run(net, 0, x))
    p += np.matmul(net.out[:, k:], _run(net, 1, x))
    p += net.shift
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p


def pooled(net: Network, data: np.ndarray, ends: np.ndarray, size: int = SEGMENT) -> np.ndarray:
    """(text, language): the mean probability over the positions of each text; zeros for empty ones."""
    start, length, text = segments(data, ends, size)
    total = np.zeros((len(ends) - 1, len(net.langs)))
    for i in range(0, len(start), BATCH):
        one = slice(i, i + BATCH)
        p = positions(net, _bytes(data, start[one], length[one], size))
        short = np.flatnonzero(length[one] < size)
        p[:, :, short] *= (np.arange(size)[:, None] < length[one][short])[:, None, :]
        np.add.at(total, text[one], p.sum(axis=0, dtype=np.float64).T)
    return total / np.maximum(np.diff(ends), 1)[:, None]


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """(mean cross entropy over the positions of segments x with languages y, its gradients for table, inner, bias, out, shift)."""
    k, size, n = net.inner.shape[2], *x.shape
    live = (x != PAD).astype(net.table.dtype)[:, None, :]
    weight = live / max(float(live.sum()), 1.0)
    kept, both = [], []
    for way in (0, 1):
        table, inner, bias = net.table[way], net.inner[way], net.bias[way]
        h, steps = np.zeros((k, n), table.dtype), []
        states = np.zeros((size, k, n), table.dtype)
        for t in range(size) if way == 0 else range(size - 1, -1, -1):
            g, u = table[:, x[t]], inner @ h
            zr = 0.5 + 0.5 * np.tanh(g[: 2 * k] + u[: 2 * k])
            z, r, v = zr[:k], zr[k:], u[2 * k :] + bias
            new = np.tanh(g[2 * k :] + r * v)
            steps.append((t, h, z, r, v, new))
            h = states[t] = h + z * (new - h)
        kept.append(steps)
        both.append(states)
    hs = np.concatenate(both, axis=1)
    p = np.matmul(net.out, hs) + net.shift
    p = np.exp(p - p.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = -float((np.log(p[:, y, np.arange(n)] + 1e-30) * weight[:, 0]).sum())
    p[:, y, np.arange(n)] -= 1
    p *= weight
    d_out, d_shift = np.einsum("tcn,tkn->ck", p, hs), p.sum(axis=(0, 2))[:, None]
    back = np.matmul(net.out.T, p)
    d_table, d_inner, d_bias = np.zeros_like(net.table), np.zeros_like(net.inner), np.zeros_like(net.bias)
    for way in (0, 1):
        inner = net.inner[way]
        carry, into = np.zeros((k, n), net.table.dtype), np.zeros((size, 3 * k, n), net.table.dtype)
        for t, h, z, r, v, new in reversed(kept[way]):
            dh = carry + back[t, way * k : (way + 1) * k]
            dn = dh * z * (1 - new * new)
            a = into[t]
            a[:k] = dh * (new - h) * 2 * z * (1 - z)
            a[k : 2 * k] = dn * v * 2 * r * (1 - r)
            a[2 * k :] = dn
            du = a.copy()
            du[2 * k :] *= r
            d_inner[way] += du @ h.T
            d_bias[way] += du[2 * k :].sum(axis=1, keepdims=True)
            carry = dh * (1 - z) + inner.T @ du
        flat = x.ravel()
        for j in range(3 * k):
            d_table[way, j] = np.bincount(flat, into[:, j].ravel(), PAD + 1)
        d_table[way, :, PAD] = 0
    return loss, [d_table, d_inner, d_bias, d_out, d_shift]


def train(texts: list[bytes], langs: list[str], steps: int = 260, batch: int = 192, rate: float = 0.03, size: int = SEGMENT, seed: int = 3) -> Network:
    """A network for the languages given; the same texts in the same order give the same one."""
    names = sorted(set(langs))
    net = blank(names, seed=seed)
    if len(names) < 2:
        return net
    data = np.frombuffer(b"".join(texts), np.uint8)
    start, length, text = segments(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), size)
    y = np.searchsorted(names, langs)[text]
    of = [np.flatnonzero(y == c) for c in range(len(names))]
    of = [o for o in of if len(o)]
    rng = np.random.default_rng(seed)
    first, second = ([np.zeros_like(a) for a in net[1:]] for _ in range(2))
    for step in range(1, steps + 1):
        own = rng.integers(0, len(of), batch)
        at = np.array([of[c][rng.integers(len(of[c]))] for c in own])
        _, grads = gradients(net, _bytes(data, start[at], length[at], size), y[at])
        scale = min(1.0, 1.0 / (sum(float((g * g).sum()) for g in grads) ** 0.5 + 1e-12))
        now = rate * (1 - 0.9 * step / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for a, g, m, v in zip(net[1:], grads, first, second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= now * m / (np.sqrt(v) + 1e-8)
    return net


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, window: int = WINDOW) -> Network:
    """Fit on at most per_language documents of each language, those first by hash, at most window code points of each.

    Rows that are held out or have a null lang or text are left out. A count per language says
    below which hash its first documents lie (four times as many as are wanted), so what is put in order does not grow with the table.
    """
    may = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = written(may.groupBy("lang").agg(F.count("*").alias("n")), "lang-counts")
    few = counts.count() <= MOST_BROADCAST
    known = may.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text").join(F.broadcast(counts) if few else counts, "lang")
    known = known.where(F.pmod("h", F.lit(1 << 32)).cast("double") * F.col("n") < float(4 * per_language << 32))
    place = F.pmod(F.col("h"), F.greatest(F.length("text") - window + 1, F.lit(1))).cast("int") + 1
    part = known.select("lang", "h", F.substring("text", place, F.lit(window)).alias("part")).where("part <> ''")
    first = part.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("r") <= per_language)
    got = first.orderBy("lang", "r").select("lang", "part").toPandas()
    return train([t.encode() for t in got["part"]], list(got["lang"]))


def _letters(docs: DataFrame) -> DataFrame:
    """doc_id, text, null where the text has no letter."""
    return docs.select("doc_id", F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row. score is the pooled probability of the language.

    Null texts and those without a letter get 'und' and 0; so do all if nothing was learnt.
    Texts of any length are read whole; repeated rows are judged each; of equal
    probabilities the first language by name; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column(1))
                known = (np.diff(t.offsets) > 0) & bool(net.langs)
                best, score = np.zeros(t.n, np.int64), np.zeros(t.n)
                if known.any():
                    p = pooled(net, t.bytes, t.offsets)
                    best, score = p.argmax(axis=1), np.minimum(p.max(axis=1), 1.0) * known
                names = pa.array([*net.langs, "und"], pa.string()).take(pa.array(np.where(known, best, len(net.langs))))
                yield pa.RecordBatch.from_arrays([part.column(0), names, pa.array(score)], ["doc_id", "lang_pred", "score"])

    return _letters(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def passages(docs: DataFrame, net: Network, least: int = 1) -> DataFrame:
    """doc_id, start, stop, lang: runs of at least `least` bytes (places in UTF-8, stop exclusive) whose positions have the same likeliest language.

    Null texts and those without a letter have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                t = Texts(part.column(1))
                if not net.langs or t.offsets[0] == t.offsets[-1]:
                    continue
                start, length, _ = segments(t.bytes, t.offsets)
                label = np.zeros(int(t.offsets[-1] - t.offsets[0]), np.int16)
                for i in range(0, len(start), BATCH):
                    s, n = start[i : i + BATCH], length[i : i + BATCH]
                    best = positions(net, _bytes(t.bytes, s, n, SEGMENT)).argmax(axis=1)
                    place = np.arange(SEGMENT)[:, None]
                    held = place < n
                    label[(s + place - t.offsets[0])[held]] = best[held]
                ends = t.offsets - t.offsets[0]
                head = np.zeros(len(label), bool)
                head[ends[:-1][np.diff(ends) > 0]] = True
                head[1:] |= label[1:] != label[:-1]
                a = np.flatnonzero(head)
                b = np.append(a[1:], len(label))
                a, b = a[b - a >= least], b[b - a >= least]
                row = np.searchsorted(ends, a, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(a - ends[row]), pa.array(b - ends[row]), pa.array(net.langs).take(pa.array(label[a]))], ["doc_id", "start", "stop", "lang"])

    return _letters(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, stop long, lang string")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row by a network learnt from those not held out."""
    return identify(docs, learn(docs)).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
