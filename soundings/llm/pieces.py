"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of three: a normaliser (the model's character map, by longest
match, then a dummy space in front and spaces to U+2581), the pieces (one arc per piece, reading its characters and writing its number) and
byte fallback (an arc per byte for characters that no piece has). An input is composed with
it lazily, place by place, and the path of least weight in the tropical semiring gives the
pieces.

In a unigram model an arc weighs minus its score. In a BPE model the pieces are those of a
merge order, which no sum of weights per piece can state; there the state also holds the
last piece, and going from piece a to b weighs 0 if merging a followed by b stops at just
these two, else infinity. A sequence of pieces is the one that merging produces exactly if
all its neighbours fit so, hence one path of finite weight is left. Whether a and b fit follows
from the merges along the right edge of a and the left edge of b, replayed in merge order.

Where no piece joins a character to a following U+2581, or a letter to what follows that is no
letter, and at characters without a piece, inputs fall apart into independent stretches, whose paths are remembered in a table of bounded size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
INF = 1 << 60
REMEMBER = 300_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 1:
            yield key >> 3, data[at : at + 8]
            at += 8
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            yield key >> 3, data[at : at + 4]
            at += 4


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of UTF-8 keys whose leaves are places in a table of texts.

    Fixed values: a unit holds its label in the low 8 bits, whether it has a leaf in bit 8, whether
    its offset is a multiple of 256 in bit 9, the offset above, and a mark of values in bit 31.
    """
    (size,) = struct.unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    out: dict[str, str] = {}

    def after(place: int, unit: int) -> int:
        return place ^ (unit >> 10 << (8 if unit >> 9 & 1 else 0))

    todo = [(after(0, units[0]), b"")] if units else []
    while todo:
        place, key = todo.pop()
        for c in range(1, 256):
            at = place ^ c
            if at < len(units) and units[at] & 0x800000FF == c:
                below = after(at, units[at])
                if units[at] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    out[(key + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
                todo.append((below, key + bytes([c])))
    return out


class Pieces:
    """A compiled model. encode() and decode() agree with the SentencePiece library for BPE and unigram models.
    A model with both a character map and user-defined pieces, which the map must not touch, is refused."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        self.score: list[float] = []
        kinds: list[int] = []
        self.bpe, self.dummy, self.squeeze, self.fallback = False, True, True, False
        self.map: dict[str, str] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.text.append(f[1].decode())
                self.score.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, 1))
            elif number == 2:
                f = dict(_fields(value))
                self.bpe, self.fallback = f.get(3, 1) == 2, bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.map = character_map(f[2]) if f.get(2) else {}
                self.dummy, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if self.map and 4 in kinds:
            raise ValueError("the model has a character map and user-defined pieces")
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted({k[0] for k in self.map})) + "]") if self.map else None
        self.longest = max(map(len, self.map), default=0)
        self.unknown = kinds.index(2)
        self.byte = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == 6}
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds)) if k in (1, 4)}
        self.kinds = kinds
        self.rank = {t: -self.score[i] for t, i in self.id.items()}
        self.split: dict[str, tuple[str, str]] = {}
        if self.bpe:
            whole = {t for t in self.id if self._derive(t)}
            self.id = {t: i for t, i in self.id.items() if t in whole}  # others never come out of merging
            for t, (a, b) in self.split.items():
                if t in whole and max(self._made(a), self._made(b)) > self.rank[t]:
                    raise ValueError("a piece is merged before its parts")
        self.alphabet = {c for t in self.id for c in t}
        self.trie: dict = {}
        for t, i in self.id.items():
            node = self.trie
            for c in t:
                node = node.setdefault(c, {})
            node[""] = i
        spell = lambda cs: "".join(re.escape(c) for c in sorted(cs))
        known, letters = self.alphabet - {SPACE}, {c for c in self.alphabet if c.isalpha()}
        other, pairs = known - letters, {x + y for t in self.id for x, y in zip(t, t[1:])}
        if not known or any(x != SPACE and y == SPACE or x in letters and y in other for x, y in pairs):
            self.stretch = re.compile(f"[{spell(self.alphabet)}]+|[^{spell(self.alphabet)}]+")
        else:  # no piece goes from a character to a space, or from a letter to another known character
            n, a = f"[{spell(other)}]" if other else "(?!)", f"[{spell(letters)}]" if letters else "(?!)"
            self.stretch = re.compile(f"{SPACE}*{n}*{a}+|{SPACE}*{n}+|{SPACE}+|[^{spell(known)}{SPACE}]+")
        self.memory: dict[str, bytes] = {}
        self.fit: dict[int, bool] = {}
        self.bytes_of = [b"" if k in (2, 3) else bytes([int(t[3:5], 16)]) if k == 6 else t.replace(SPACE, " ").encode() for t, k in zip(self.text, kinds)]

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": {}, "fit": {}}

    def _made(self, piece: str) -> float:
        """When merging makes the piece; characters are there from the start."""
        return self.rank[piece] if len(piece) > 1 else -1.0

    def _derive(self, piece: str) -> bool:
        """Merge the characters of a piece, keeping each merge in `split`; whether just the piece is left."""
        parts = list(piece)
        while len(parts) > 1:
            pairs = [(self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank]
            if not pairs:
                return False
            i = min(pairs)[1]
            self.split[parts[i] + parts[i + 1]] = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def fits(self, x: int, y: int) -> bool:
        """Whether merging piece x followed by piece y ends with these two: their edges are replayed in merge order, and no merge across may come first."""
        left, right = [self.text[x]], [self.text[y]]
        while len(left[-1]) > 1:
            left.append(self.split[left[-1]][1])
        while len(right[-1]) > 1:
            right.append(self.split[right[-1]][0])
        i, j = len(left) - 1, len(right) - 1
        while True:
            across = self.rank.get(left[i] + right[j], INF)
            grow_left = self.rank[left[i - 1]] if i else INF
            grow_right = self.rank[right[j - 1]] if j else INF
            if across < grow_left and across <= grow_right:
                return False
            if not i and not j:
                return True
            if grow_left <= grow_right:
                i -= 1
            else:
                j -= 1

    def arcs(self, s: str, i: int) -> list[tuple[int, int]]:
        """(piece, place after it) of the pieces that read s from place i on, shortest first."""
        out, node, n = [], self.trie, len(s)
        while i < n:
            node = node.get(s[i])
            if node is None:
                break
            i += 1
            k = node.get("")
            if k is not None:
                out.append((k, i))
        return out

    def _merged(self, s: str) -> list[int]:
        """The one path of finite weight through a BPE model's states (place, last piece), depth first, long pieces first.

        Whatever leads to a place, the piece before it is the same (the last one of that
        prefix), so a place that did not lead on never will.
        """
        n, i, last = len(s), 0, -1
        out: list[int] = []
        back: list[tuple[int, int, list]] = []
        dead: set[int] = set()
        fit, arcs = self.fit, self.arcs
        todo = arcs(s, 0)
        while True:
            if todo:
                k, j = todo.pop()
                if j in dead:
                    continue
                if last >= 0:
                    pair = last << 24 | k
                    ok = fit.get(pair)
                    if ok is None:
                        if len(fit) >= 4 * REMEMBER:
                            fit.clear()
                        ok = fit[pair] = self.fits(last, k)
                    if not ok:
                        continue
                out.append(k)
                if j == n:
                    return out
                back.append((i, last, todo))
                i, last, todo = j, k, arcs(s, j)
            else:
                dead.add(i)
                i, last, todo = back.pop()
                out.pop()

    def path(self, s: str) -> list[int]:
        """The least-weight path over a stretch of known characters."""
        if self.bpe:
            return self._merged(s)
        n = len(s)
        best: list[tuple[float, int, int]] = [(0.0, -1, -1)] + [(float("inf"), -1, -1)] * n
        for i in range(n):
            for k, j in self.arcs(s, i):
                w = best[i][0] - self.score[k]
                if w < best[j][0]:
                    best[j] = (w, i, k)
        out = []
        while n:
            _, n, k = best[n]
            out.append(k)
        return out[::-1]

    def _stretch(self, s: str) -> bytes:
        if s[0] in self.alphabet or s[0] == SPACE and SPACE in self.alphabet:
            ids = self.path(s)
        elif self.fallback:
            ids = [self.byte[b] for b in s.encode()]
        else:
            ids = [self.unknown]
        out = np.array(ids, np.int32).tobytes()
        if len(s) <= 64:
            if len(self.memory) >= REMEMBER:
                self.memory.clear()
            self.memory[s] = out
        return out

    def mapped(self, text: str) -> str:
        """The text with the longest key of the character map at each place replaced."""
        if self.starts is None:
            return text
        out, at = [], 0
        while m := self.starts.search(text, at):
            i = m.start()
            n = next((n for n in range(min(self.longest, len(text) - i), 0, -1) if text[i : i + n] in self.map), 0)
            out += [text[at:i], self.map[text[i : i + n]] if n else text[i]]
            at = i + max(n, 1)
        return "".join(out) + text[at:]

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        text = self.mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
            if not text:
                return ""
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> np.ndarray:
        get, make = self.memory.get, self._stretch
        return np.frombuffer(b"".join([get(s) or make(s) for s in self.stretch.findall(self.normalise(text))]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.dummy and out[:1] == " " else out


def encode(docs: DataFrame, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, ids, round_trip: one row per input row.

    round_trip: whether decoding the ids gives the normalised text back (false where a text
    itself holds U+2581, which decoding cannot tell from a space). Null and empty texts have no
    pieces; texts of any length are read whole; repeated rows are encoded each; an empty table
    gives no rows; other columns are ignored. The model file is read on the driver and
    broadcast compiled (its size is that of the vocabulary).
    """
    with open(model_path, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(Pieces(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Pieces = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, same = [], []
                for text in part.column(1).to_pylist():
                    text = text or ""
                    ids.append(p.encode(text))
                    same.append(p.decode(ids[-1]) == (p.normalise(text)[1:] if p.dummy else p.normalise(text)).replace(SPACE, " ") and SPACE not in p.mapped(text))
                n = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat)), pa.array(same, pa.bool_())],
                    ["doc_id", "n_pieces", "ids", "round_trip"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) -> doc_id, text; null ids give ''."""
    with open(model_path, "rb") as f:
        held = encoded.sparkSession.sparkContext.broadcast(Pieces(f.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [held.value.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
