"""Reader for SON ping files: headers by byte ranges, and their samples.

A ping starts with 4 fixed bytes and tagged big-endian fields, ends its header with one
fixed byte, and holds as many sample bytes as its last field says. Three layouts differ in
where the later fields stand.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import files
from .files import decode  # noqa: F401

#: Byte layout. field -> (offset, struct code); the header length names the layout.
START, END = bytes.fromhex("c0deab21"), 0x21
COMMON = {"record_num": (5, ">I"), "time_ms": (10, ">I"), "utm_e": (15, ">i"), "utm_n": (20, ">i"), "gps1": (25, ">H"), "heading_dd": (27, ">H"), "gps2": (30, ">H"), "speed_cm": (32, ">H")}
LAYOUTS = {
    67: COMMON | {"depth_cm": (35, ">I"), "beam_no": (40, ">B"), "volt": (42, ">B"), "f": (44, ">I"), "ping_cnt": (62, ">I")},
    72: COMMON | {"depth_cm": (40, ">I"), "beam_no": (45, ">B"), "volt": (47, ">B"), "f": (49, ">I"), "ping_cnt": (67, ">I")},
    152: COMMON | {"depth_cm": (40, ">I"), "beam_no": (85, ">B"), "volt": (87, ">B"), "f": (89, ">I"), "ping_cnt": (147, ">I")},
}
#: Tag bytes before fields, by layout.
TAGS = {
    67: {4: 0x80, 9: 0x81, 14: 0x82, 19: 0x83, 24: 0x84, 29: 0x85, 34: 0x87, 39: 0x50, 41: 0x51, 43: 0x92, 48: 0x53, 50: 0x54, 52: 0x95, 57: 0x56, 59: 0x57, 61: 0xA0},
    72: {4: 0x80, 9: 0x81, 14: 0x82, 19: 0x83, 24: 0x84, 29: 0x85, 34: 0x86, 39: 0x87, 44: 0x50, 46: 0x51, 48: 0x92, 53: 0x53, 55: 0x54, 57: 0x95, 62: 0x56, 64: 0x57, 66: 0xA0},
    152: {4: 0x80, 9: 0x81, 14: 0x82, 19: 0x83, 24: 0x84, 29: 0x85, 34: 0x86, 39: 0x87, 44: 0x88, 84: 0x50, 86: 0x51, 88: 0x92, 93: 0x53, 95: 0x54, 97: 0x95, 102: 0x56, 104: 0x57, 146: 0xA0},
}
BEAMS = {0: "ds_lowfreq", 1: "ds_hifreq", 2: "ss_port", 3: "ss_star", 4: "ds_vhifreq"}
SCHEMA = "record_num long, time_s double, utm_e double, utm_n double, instr_heading double, speed_ms double, inst_dep_m double, beam string, volt_scale double, f double, ping_cnt int, `index` long, son_offset long"


def _layout(data: bytes, at: int, among: tuple[int, ...] = tuple(LAYOUTS)) -> int:
    """The header length whose end byte and tags stand where they should, of those in `among`; 0 if none does."""
    for n in among:
        end = at + n - 1
        if len(data) > end and data[end] == END and all(data[at + o] == t for o, t in TAGS[n].items()):
            return n
    return 0


def layout_of(data: bytes, at: int = 0) -> int:
    n = _layout(data, at)
    if not n:
        raise ValueError(f"no known header at byte {at}")
    return n


def headers(data: bytes | files.Bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA for each ping that starts in [start, stop); bytes between pings are skipped to the next start.

    From the middle of a file, reading begins at the first place that has all the fixed bytes
    of the file's layout; the start of a file must have a header.
    """
    data = files.Bytes.of(data)
    stop = data.size if stop is None else stop
    top = data.peek(0, 4096) if start else b""
    n = _layout(top, max(top.find(START), 0))
    at = data.find(START, start, stop)
    while at >= 0 and at + min(LAYOUTS) <= data.size:
        head = data.get(at, max(LAYOUTS))
        fit = _layout(head, 0, (n,) if n else tuple(LAYOUTS))
        if not fit:
            if not n and not start:
                raise ValueError(f"no known header at byte {at}")
            at = data.find(START, at + 1, stop)
            continue
        n = fit
        v = {k: struct.unpack_from(code, head, o)[0] for k, (o, code) in LAYOUTS[n].items()}
        yield (
            v["record_num"], v["time_ms"] / 1000, float(v["utm_e"]), float(v["utm_n"]), v["heading_dd"] / 10, v["speed_cm"] / 100, v["depth_cm"] / 100,
            BEAMS.get(v["beam_no"], f"unknown_{v['beam_no']}"), v["volt"] / 10, float(v["f"]), v["ping_cnt"], at, n,
        )
        at = data.find(START, at + n + v["ping_cnt"], stop)


def encode_ping(layout: int, samples: bytes, **fields: int) -> bytes:
    """One ping in a layout: the inverse of headers(), for writing and for tests."""
    out = bytearray(layout)
    out[:4], out[-1] = START, END
    for at, tag in TAGS[layout].items():
        out[at] = tag
    for k, (o, code) in LAYOUTS[layout].items():
        struct.pack_into(code, out, o, len(samples) if k == "ping_cnt" else fields.get(k, 0))
    return bytes(out) + samples


def read(spark: SparkSession, path: str | list[str], split: int = files.SPLIT) -> DataFrame:
    """Ping headers of SON files of any store, by byte ranges: SCHEMA, error and path. A file that cannot be read gives a row with its error."""
    return files.read(spark, path, "son", split, files.Wanted(SCHEMA))


class SonSource(files.RangeSource):
    """spark.dataSource.register(SonSource); spark.read.format("son").load("a.SON,b.SON"), in ranges of option split bytes."""

    form = "son"
    columns = SCHEMA


def samples(spark: SparkSession, path: str | list[str], pings: DataFrame, width: int = 1, big: bool = True, split: int = files.SPLIT) -> DataFrame:
    """files.samples for pings of the files below path: samples ARRAY<DOUBLE> of bytes [index + son_offset, + ping_cnt * width)."""
    return files.samples(files.listing(spark, path), pings, width, big, split)
