"""Reader for JSF files: messages with a header of 16 bytes, of which type 80 holds a ping of one channel.

Such a message has 240 bytes of little-endian fields before its samples, 16-bit words to be
scaled by 2 ** -weight. Messages of other types are skipped by their length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Byte layout. field -> (offset, struct code).
MARKER, HEADER, TRACE, SONAR = 0x1601, 16, 240, 80
MESSAGE = {"type": (4, "<H"), "subsystem": (7, "<B"), "channel": (8, "<B"), "length": (12, "<I")}
PING = {
    "time": (0, "<i"), "ping": (8, "<I"), "format": (34, "<h"), "x": (80, "<i"), "y": (84, "<i"), "units": (88, "<h"), "samples": (114, "<H"), "interval_ns": (116, "<I"), "start_dahz": (126, "<H"),
    "end_dahz": (128, "<H"), "altitude_mm": (144, "<i"), "sound_speed": (148, "<f"), "weight": (168, "<h"), "heading": (172, "<H"), "millis": (200, "<I"), "most": (204, "<H"),
}
#: Subsystem numbers of side scans; further ones get a suffix in this order.
SUBSYSTEMS = {20: "", 21: "_2", 22: "_3"}
#: What a pair of coordinates counts in.
MILLIMETRES, ARC_MINUTES, DECIMETRES = 1, 2, 3
#: Messages in a row that show where one starts.
CHAIN = 3
#: Shorts per sample by data format.
SHORTS = {0: 1, 1: 2, 2: 1, 3: 1, 4: 1, 9: 1}


def _fields(layout: dict[str, tuple[int, str]], data: bytes, at: int) -> dict:
    return {k: struct.unpack_from(code, data, at + o)[0] for k, (o, code) in layout.items()}


def _beam(subsystem: int, channel: int) -> str:
    if subsystem in SUBSYSTEMS and channel in (0, 1):
        return ("ss_port", "ss_star")[channel] + SUBSYSTEMS[subsystem]
    return "ds_lowfreq" if subsystem == 0 else f"unknown_{subsystem}_{channel}"


def sync(data: files.Bytes, at: int, stop: int) -> int:
    """The first message that starts in [at, stop), -1 if there is none.

    Two bytes of marker also occur in samples, so they must be followed by a chain of messages,
    each where the one before says, or be a sonar message whose length is that of its samples.
    """
    mark = MARKER.to_bytes(2, "little")

    def sonar(at: int) -> bool:
        head = data.get(at, HEADER + TRACE)
        if len(head) < HEADER:
            return False
        m = _fields(MESSAGE, head, 0)
        if m["type"] != SONAR or m["channel"] > 1:
            return False
        if len(head) < HEADER + TRACE:
            return True  # cut off by the end of the file
        p = _fields(PING, head, HEADER)
        return m["length"] == TRACE + p["samples"] * 2 * SHORTS.get(p["format"], 1)

    def chained(at: int) -> bool:
        for _ in range(CHAIN):
            head = data.get(at, HEADER)
            if len(head) < HEADER or head[:2] != mark:
                return mark.startswith(head[:2])
            m = _fields(MESSAGE, head, 0)
            if not m["length"] or (m["type"] == SONAR and not sonar(at)):
                return False
            at += HEADER + m["length"]
            if at > data.size:
                return False
        return True

    while (at := data.find(mark, at, stop)) >= 0:
        if chained(at) or sonar(at):
            return at
        at += 1
    return -1


def rows(data: bytes | files.Bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows of files.SCHEMA: one for each sonar message that starts in [start, stop)."""
    data = files.Bytes.of(data)
    stop = data.size if stop is None else stop
    at = sync(data, start, stop)
    if at < 0 and not start and (stop == data.size or sync(data, stop, data.size) < 0):
        raise ValueError("no JSF message")
    while 0 <= at < stop and at + HEADER <= data.size:
        head = data.get(at, HEADER + TRACE)
        if struct.unpack_from("<H", head, 0)[0] != MARKER:
            at = sync(data, at + 1, stop)
            continue
        m = _fields(MESSAGE, head, 0)
        if m["type"] == SONAR:
            if len(head) < HEADER + TRACE:
                raise ValueError(f"the message at byte {at} is cut off")
            p = _fields(PING, head, HEADER)
            lon = lat = e = n = None
            if p["units"] == ARC_MINUTES:
                lon, lat = p["x"] / 600000, p["y"] / 600000
            elif p["units"] in (MILLIMETRES, DECIMETRES):
                k = 1000 if p["units"] == MILLIMETRES else 10
                e, n = p["x"] / k, p["y"] / k
            speed = p["sound_speed"] if 0 < p["sound_speed"] < 3000 else 1500.0
            yield (
                _beam(m["subsystem"], m["channel"]), p["ping"], p["time"] + p["millis"] % 1000 / 1000, lon, lat, e, n, p["heading"] / 100, None, p["altitude_mm"] / 1000, p["samples"],
                p["interval_ns"] * 1e-9 * speed / 2, (p["start_dahz"] + p["end_dahz"]) * 5.0, at, HEADER + TRACE, 2 * SHORTS.get(p["format"], 1), float(p["weight"]), float(p["most"]),
            )
        at += HEADER + m["length"]


def encode(messages: list[tuple[dict, dict, bytes]]) -> bytes:
    """Sonar messages from (fields of MESSAGE, fields of PING, sample bytes): the inverse of rows(), for tests."""
    out = bytearray()
    for m, p, raw in messages:
        head, trace = bytearray(HEADER), bytearray(TRACE)
        struct.pack_into("<H", head, 0, MARKER)
        for k, (o, code) in MESSAGE.items():
            struct.pack_into(code, head, o, {"type": SONAR, "length": TRACE + len(raw), **m}.get(k, 0))
        for k, (o, code) in PING.items():
            struct.pack_into(code, trace, o, {"samples": len(raw) // 2, **p}.get(k, 0))
        out += head + trace + raw
    return bytes(out)


def read(spark: SparkSession, path: str | list[str], split: int = files.SPLIT, wanted: files.Wanted = files.Wanted()) -> DataFrame:
    """Pings of JSF files by byte ranges: wanted.kind(), error and path; samples are little-endian (for son.samples: big=False), their scale is weighting_factor."""
    return files.read(spark, path, "jsf", split, wanted)


class JsfSource(files.RangeSource):
    form = "jsf"
