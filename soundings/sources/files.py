"""Recordings as binary files, read by byte ranges: files of any size, from any store that pyarrow's file systems open.

A format is a function rows(data, start, stop) that yields tuples for the records that start in
[start, stop), finding the first one by itself when start is in the middle of the file. A
range reads what its records need beyond stop, so every record is read once, by one range.
A file that cannot be read gives what came before the fault and a row that holds only its
path and the error, so one bad file does not end a job over many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns that every format gives; what a format lacks is null. offsets count from the start of the file.
SCHEMA = (
    "beam string, record_num long, time_s double, lon double, lat double, e double, n double, instr_heading double, speed_ms double, inst_dep_m double, ping_cnt int, pixM double, f double, "
    "`index` long, son_offset long, bytes_per_sample int, weighting_factor double, max_abs_adc_raw double"
)
#: Bytes of a range, of a read, and of the samples of an Arrow batch; most ranges are dealt one to a partition.
SPLIT, BLOCK, BATCH, PARTITIONS = 64 << 20, 4 << 20, 16 << 20, 20_000


def names(schema: str) -> list[str]:
    return [c.split()[0].strip("`") for c in schema.split(",")]


#: Types of the readers' columns; workers have no session to parse DDL with.
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0].strip("`"), ARROW[c.split()[1]]) for c in schema.split(",")])


class Bytes:
    """A file read by position. One block is held, so reads that go forward fetch each byte once."""

    def __init__(self, file: pa.NativeFile, block: int = BLOCK):
        self.file, self.size, self.block = file, file.size(), block
        self.base, self.held = 0, b""

    @classmethod
    def of(cls, data: bytes | Bytes) -> Bytes:
        return data if isinstance(data, Bytes) else cls(pa.BufferReader(data))

    def peek(self, at: int, n: int) -> bytes:
        """n bytes, fewer at the end of the file; the held block stays."""
        self.file.seek(min(at, self.size))
        return self.file.read(n)

    def get(self, at: int, n: int) -> bytes:
        """n bytes, fewer at the end of the file."""
        if not self.base <= at <= at + n <= self.base + len(self.held):
            self.base, self.held = at, self.peek(at, max(n, self.block))
        return self.held[at - self.base : at - self.base + n]

    def find(self, what: bytes, at: int, stop: int | None = None) -> int:
        """The first place of `what` in [at, stop), -1 if there is none."""
        stop = self.size if stop is None else min(stop, self.size)
        while at < stop:
            if not self.base <= at <= self.base + len(self.held) - len(what):
                self.base, self.held = at, self.peek(at, self.block)
            i = self.held.find(what, at - self.base, stop - self.base + len(what) - 1)
            if i >= 0:
                return self.base + i
            at = self.base + max(len(self.held) - len(what) + 1, 1)
        return -1


def opened(path: str) -> Bytes:
    """A file by its path or URI, as Spark names it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, inner = (fs.LocalFileSystem(), path) if ":" not in path.split("/")[0] else fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return Bytes(store.open_input_file(inner))


def decode(raw: bytes, width: int = 1, flip: bool = False, crop: int = 0, exponent: int | None = None, big: bool = True) -> np.ndarray:
    """Samples of one ping: unsigned bytes or words of `width` bytes (big-endian or not), scaled by 2 ** -exponent, flipped, cropped."""
    v = np.frombuffer(raw[: len(raw) // width * width], f"{'>' if big else '<'}u{width}").astype(np.float64)
    v = v * 2.0**-exponent if exponent is not None else v
    v = v[::-1] if flip else v
    return v[:crop] if crop else v


class Format(NamedTuple):
    rows: Callable[[Bytes, int, int | None], Iterator[tuple]]
    columns: list[str]
    big: bool


def formats() -> dict[str, Format]:
    from . import jsf, son, xtf

    return {"son": Format(son.headers, names(son.SCHEMA), True), "jsf": Format(jsf.rows, names(SCHEMA), False), "xtf": Format(xtf.rows, names(SCHEMA), False)}


class Wanted(NamedTuple):
    """What of a recording is read: columns (with samples or without), some beams, record numbers of [least, most]."""

    schema: str = SCHEMA
    samples: bool = False
    beams: frozenset[str] | None = None
    least: float = float("-inf")
    most: float = float("inf")

    def kind(self) -> str:
        return f"{self.schema}, samples array<double>" if self.samples else self.schema


def _ping_samples(data: Bytes, at: int | None, offset: int, count: int | None, width: int | None, weight: float | None, big: bool) -> np.ndarray | None:
    """The samples of one ping; None without an index or beyond the end of the file."""
    if at is None or count is None or at + offset + count * (width or 1) > data.size:
        return None
    return decode(data.get(at + offset, count * (width or 1)), width or 1, exponent=None if weight is None else int(weight), big=big)


def batches(data: Bytes, kind: Format, start: int, stop: int | None, wanted: Wanted) -> Iterator[pa.RecordBatch]:
    """Arrow batches of wanted.kind() for the records of one range. Rows that are not wanted cost neither samples nor a place in a batch."""
    schema = arrow(wanted.kind())
    place = {c: i for i, c in enumerate(kind.columns)}
    beam, number, size, at, offset = (place[c] for c in ("beam", "record_num", "ping_cnt", "index", "son_offset"))
    width, weight = place.get("bytes_per_sample"), place.get("weighting_factor")
    plain = [place.get(c) for c in names(wanted.schema)]
    held: list[tuple] = []
    weighs = 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held))
        arrays = [pa.nulls(len(held), f.type) if i is None else pa.array(columns[i], f.type) for i, f in zip(plain, schema)]
        if wanted.samples:
            arrays.append(pa.array(columns[-1], schema[-1].type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    try:
        for r in kind.rows(data, start, stop):
            if (wanted.beams is None or r[beam] in wanted.beams) and wanted.least <= r[number] <= wanted.most:
                if wanted.samples:
                    got = _ping_samples(data, r[at], r[offset], r[size], r[width] if width is not None else 1, r[weight] if weight is not None else None, kind.big)
                    weighs += 0 if got is None else got.nbytes
                    r = (*r, got)
                held.append(r)
                if len(held) == 4096 or weighs > BATCH:
                    yield batch()
                    held, weighs = [], 0
    except Exception:
        if held:
            yield batch()  # what came before the fault
        raise
    if held:
        yield batch()


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and length of files or of the files in folders; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def ranges(found: DataFrame, split: int = SPLIT) -> DataFrame:
    """found (path, length, ...) with start and stop: a row for each range of `split` bytes, dealt to as many partitions. Files of no bytes give none.

    A null length is a file that could not be opened: one range, whose reading tells the error.
    """
    cut = found.where("length IS NULL OR length > 0").withColumn("start", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("length") - 1, F.lit(0)), F.lit(split))))
    total = found.agg(F.sum(F.coalesce(F.ceil(F.col("length") / split), F.lit(1)))).first()[0] or 1
    # A given number, as adaptive merging would put ranges, which are short rows, into one task.
    return cut.withColumn("stop", F.least(F.col("start") + split, "length")).repartition(int(min(max(total, 1), PARTITIONS)))


def read_ranges(cut: DataFrame, wanted: Wanted = Wanted()) -> DataFrame:
    """wanted.kind(), error and path of ranges (path, format, start, stop). Formats without a reader give a row with the error."""
    kinds, kind = formats(), f"{wanted.kind()}, error string, path string"
    schema = arrow(kind)

    def told(path: str, error: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-2]), pa.array([error]), pa.array([path])], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in part.to_pylist():
                if r["format"] not in kinds:
                    if r["start"] == 0:
                        yield told(r["path"], f"no reader for {r['format'] or 'this'} format")
                    continue
                try:
                    for b in batches(opened(r["path"]), kinds[r["format"]], r["start"], r["stop"], wanted):
                        yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(len(b), pa.string()), pa.array([r["path"]] * len(b))], schema=schema)
                except Exception as fault:  # whatever a damaged file causes
                    yield told(r["path"], f"{type(fault).__name__}: {fault}")

    return cut.select("path", "format", "start", "stop").mapInArrow(run, kind)


def read(spark: SparkSession, path: str | list[str], form: str, split: int = SPLIT, wanted: Wanted = Wanted()) -> DataFrame:
    """Pings of the files of one format: wanted.kind(), error and path."""
    return read_ranges(ranges(listing(spark, path).withColumn("format", F.lit(form)), split), wanted)


def sized(found: DataFrame) -> DataFrame:
    """path and format with length, asked of the store by the workers; null where a file cannot be opened."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def size(path: str) -> int | None:
            try:
                return opened(path).size
            except OSError:
                return None

        for part in parts:
            yield part.assign(length=pd.array([size(p) for p in part["path"]], "Int64"))

    return found.select("path", "format").mapInPandas(run, "path string, format string, length long")


def open_all(spark: SparkSession, recordings: DataFrame | str, split: int = SPLIT, wanted: Wanted = Wanted()) -> DataFrame:
    """Pings of all recordings of a folder, or of a table of path and format (tables.find_recordings): wanted.kind(), error, path, rec_id.

    One scan over the byte ranges of all files, whatever their formats; no file name goes to the driver. Formats without a
    reader give a row with the error; files of no bytes are not listed.
    """
    from . import tables

    found = tables.find_recordings(spark, recordings, "*") if isinstance(recordings, str) else recordings
    found = found.select("path", "format", "length") if "length" in found.columns else sized(found)
    return read_ranges(ranges(found, split), wanted).withColumn("rec_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))


def samples(found: DataFrame, pings: DataFrame, width: int = 1, big: bool = True, split: int = SPLIT) -> DataFrame:
    """pings (path, index, son_offset, ping_cnt) with samples ARRAY<DOUBLE> of files found (path, length).

    A column bytes_per_sample gives each ping's width, a column weighting_factor its scale 2 ** -w. Pings without an index,
    that reach past the end of the file or whose file is not found get null. Pings are dealt by stretches of `split` bytes
    and read in order, so a task reads its stretches once and holds a block and a batch.
    """
    total = found.agg(F.sum(F.ceil(F.col("length") / split))).first()[0] or 1
    fields = pings.columns
    named: dict[str, Column] = {"at": F.col("index"), "off": F.col("son_offset"), "count": F.col("ping_cnt")}
    named["wide"] = F.coalesce(F.col("bytes_per_sample"), F.lit(width)) if "bytes_per_sample" in fields else F.lit(width)
    named["weight"] = F.col("weighting_factor") if "weighting_factor" in fields else F.lit(None)
    need = F.struct(*(c.cast("double" if n == "weight" else "long").alias(n) for n, c in named.items())).alias("_need")
    known = pings.select("*", need).join(found.select("path", F.lit(True).alias("_found")), "path", "left").select(*pings.columns, "_need", "_found")
    dealt = known.repartition(int(min(max(total, 1), PARTITIONS)), F.col("path"), F.floor(F.col("_need.at") / split)).sortWithinPartitions("path", "_need.at")
    kind = T.StructType([*pings.schema.fields, T.StructField("samples", T.ArrayType(T.DoubleType()))])
    schema = to_arrow_schema(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, data = None, None
        for part in parts:
            begin, weighs, got = 0, 0, []
            whole = pa.Table.from_batches([part])
            for p, need, there in zip(part.column("path").to_pylist(), part.column("_need").to_pylist(), part.column("_found").to_pylist()):
                if there and p != path:
                    path, data = p, opened(p)
                v = _ping_samples(data, need["at"], need["off"] or 0, need["count"], need["wide"], need["weight"], big) if there else None
                got.append(v)
                weighs += 0 if v is None else v.nbytes
                if weighs > BATCH or begin + len(got) == len(part):
                    out = whole.slice(begin, len(got)).drop_columns(["_need", "_found"]).append_column("samples", pa.array(got, pa.list_(pa.float64())))
                    yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(out.columns, schema)], schema=schema).combine_chunks().to_batches()
                    begin, weighs, got = begin + len(got), 0, []

    return dealt.mapInArrow(run, kind)


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class RangeReader(DataSourceReader):
    """Ranges of `split` bytes as partitions."""

    def __init__(self, form: str, paths: list[str], split: int, wanted: Wanted):
        self.form, self.paths, self.split, self.wanted = form, paths, split, wanted

    def partitions(self) -> list[Range]:
        return [Range(p, a, min(a + self.split, size)) for p in self.paths for size in [opened(p).size] for a in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from batches(opened(partition.path), formats()[self.form], partition.start, partition.stop, self.wanted)


class FilteringReader(RangeReader):
    """Takes filters on beam and record_num; Spark accepts it only where spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            w, column = self.wanted, getattr(f, "attribute", None)
            if column == ("beam",) and isinstance(f, (EqualTo, In)):
                some = frozenset(f.value if isinstance(f, In) else [f.value])
                self.wanted = w._replace(beams=some if w.beams is None else w.beams & some)
            elif column == ("record_num",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else w.least
                most = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else w.most
                self.wanted = w._replace(least=max(w.least, least), most=min(w.most, most))
            else:
                yield f


class RangeSource(DataSource):
    """Base of the data sources son, xtf and jsf. Options: path (comma-separated), split (bytes of a task), samples (true: with a column of them), filters (true: FilteringReader)."""

    form = ""
    columns = SCHEMA

    @classmethod
    def name(cls) -> str:
        return cls.form

    def _wanted(self) -> Wanted:
        return Wanted(self.columns, self.options.get("samples", "false").lower() == "true")

    def schema(self) -> str:
        return self._wanted().kind()

    def reader(self, schema) -> DataSourceReader:
        paths = [p for p in self.options.get("path", "").split(",") if p]
        kind = FilteringReader if self.options.get("filters", "false").lower() == "true" else RangeReader
        return kind(self.form, paths, int(self.options.get("split", SPLIT)), self._wanted())
