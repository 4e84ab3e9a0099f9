"""Reader for XTF files: a header of 1,024 bytes with the channels, then packets of little-endian fields.

A sonar packet has a header of 256 bytes and, for each channel, one of 64 bytes before its
samples. Packets of other kinds are skipped by their length.
"""

from __future__ import annotations

import calendar
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from . import files

#: Byte layout. field -> (offset, struct code).
FORMAT, FILE_HEADER, CHANNEL, CHANNELS_AT = 0x7B, 1024, 128, 256
MAGIC, PACKET, PART = 0xFACE, 256, 64
FILE = {"nav_units": (164, "<H"), "sonar_channels": (166, "<H"), "bathy_channels": (168, "<H")}
INFO = {"kind": (0, "<B"), "bytes": (6, "<H"), "volt": (28, "<f"), "frequency": (32, "<f")}
PING = {
    "kind": (2, "<B"), "channels": (4, "<H"), "length": (10, "<I"), "year": (14, "<H"), "month": (16, "<B"), "day": (17, "<B"), "hour": (18, "<B"), "minute": (19, "<B"), "second": (20, "<B"),
    "hundredths": (21, "<B"), "ping": (28, "<I"), "gyro": (124, "<f"), "speed": (120, "<f"), "ship_y": (128, "<d"), "ship_x": (136, "<d"), "sensor_y": (160, "<d"), "sensor_x": (168, "<d"),
    "altitude": (196, "<f"), "heading": (212, "<f"),
}
PART_OF = {"channel": (0, "<H"), "slant": (4, "<f"), "frequency": (26, "<H"), "samples": (42, "<I"), "weight": (58, "<h")}
SIDES = {0: "ds_lowfreq", 1: "ss_port", 2: "ss_star"}
LON_LAT = 3
#: Packets in a row that show where one starts.
CHAIN = 3
KNOT = 0.514444


def _fields(layout: dict[str, tuple[int, str]], data: bytes, at: int) -> dict:
    return {k: struct.unpack_from(code, data, at + o)[0] for k, (o, code) in layout.items()}


def beams(channels: list[dict]) -> list[str]:
    """Beam names of the channels: sides, with _2, _3 ... for further ones of a side; others by number."""
    seen: dict[str, int] = {}
    out = []
    for i, c in enumerate(channels):
        name = SIDES.get(c["kind"], f"unknown_{i}")
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def sync(data: files.Bytes, at: int, stop: int, n: int) -> int:
    """The first packet that starts in [at, stop), -1 if there is none.

    Two bytes of magic also occur in samples, so they must be followed by a chain of packets,
    each where the one before says, or by the date and channel fields of a sonar packet.
    """
    mark = MAGIC.to_bytes(2, "little")

    def chained(at: int) -> bool:
        for _ in range(CHAIN):
            head = data.get(at, 14)
            if len(head) < 14 or head[:2] != mark:
                return mark.startswith(head[:2])
            length = struct.unpack_from("<I", head, 10)[0]
            at += length
            if length < PACKET or at > data.size:
                return False
        return True

    def dated(at: int) -> bool:
        head = data.get(at, PACKET + PART)
        if len(head) < PACKET + PART or head[2] != 0:
            return False
        p, part = _fields(PING, head, 0), _fields(PART_OF, head, PACKET)
        clock = 1 <= p["month"] <= 12 and 1 <= p["day"] <= 31 and p["hour"] < 24 and p["minute"] < 60 and p["second"] < 61 and p["hundredths"] < 100
        return clock and 0 < p["channels"] <= n and part["channel"] < n and PACKET + PART <= p["length"] < 1 << 26

    while (at := data.find(mark, at, stop)) >= 0:
        if chained(at) or dated(at):
            return at
        at += 1
    return -1


def rows(data: bytes | files.Bytes, start: int = 0, stop: int | None = None) -> Iterator[tuple]:
    """Rows of files.SCHEMA: one for each channel of each sonar packet that starts in [start, stop)."""
    data = files.Bytes.of(data)
    stop = data.size if stop is None else stop
    top = data.peek(0, FILE_HEADER)
    if len(top) < FILE_HEADER or top[0] != FORMAT:
        if start:
            return  # the first range tells
        raise ValueError("no XTF file header")
    head = _fields(FILE, top, 0)
    n = head["sonar_channels"] + head["bathy_channels"]
    if n > 6:
        if start:
            return
        raise ValueError(f"{n} channels do not fit the file header")
    channels = [_fields(INFO, top, CHANNELS_AT + CHANNEL * i) for i in range(n)]
    named = beams(channels)
    at = FILE_HEADER if start <= FILE_HEADER else sync(data, start, stop, n)
    while 0 <= at < stop and at + PACKET <= data.size:
        packet = data.get(at, PACKET)
        if struct.unpack_from("<H", packet, 0)[0] != MAGIC:
            at = sync(data, at + 1, stop, n)
            continue
        p = _fields(PING, packet, 0)
        if p["kind"] == 0:
            time = calendar.timegm((p["year"], p["month"], p["day"], p["hour"], p["minute"], p["second"])) + p["hundredths"] / 100
            x, y = (p["sensor_x"], p["sensor_y"]) if p["sensor_x"] or p["sensor_y"] else (p["ship_x"], p["ship_y"])
            lon, lat, e, north = (x, y, None, None) if head["nav_units"] == LON_LAT else (None, None, x, y)
            part = at + PACKET
            for _ in range(p["channels"]):
                if part + PART > data.size:
                    raise ValueError(f"the packet at byte {at} is cut off")
                c = _fields(PART_OF, data.get(part, PART), 0)
                if c["channel"] >= n:
                    raise ValueError(f"the packet at byte {at} names channel {c['channel']} of {n}")
                width, count = channels[c["channel"]]["bytes"], c["samples"]
                yield (
                    named[c["channel"]], p["ping"], time, lon, lat, e, north, p["heading"] or p["gyro"], p["speed"] * KNOT, p["altitude"], count, c["slant"] / count if count else None,
                    float(c["frequency"] or channels[c["channel"]]["frequency"]), at, part + PART - at, width, float(c["weight"]), None,
                )
                part += PART + count * width
        at += max(p["length"], PACKET)


def encode(channels: list[dict], pings: list[dict], nav_units: int = LON_LAT) -> bytes:
    """A file of sonar packets: the inverse of rows(), for tests. pings: fields of PING, and parts: (fields of PART_OF, sample bytes)."""

    def fill(size: int, layout: dict[str, tuple[int, str]], values: dict) -> bytearray:
        out = bytearray(size)
        for k, (o, code) in layout.items():
            struct.pack_into(code, out, o, values.get(k, 0))
        return out

    out = fill(FILE_HEADER, FILE, {"nav_units": nav_units, "sonar_channels": len(channels)})
    out[0] = FORMAT
    for i, c in enumerate(channels):
        out[CHANNELS_AT + CHANNEL * i : CHANNELS_AT + CHANNEL * (i + 1)] = fill(CHANNEL, INFO, c)
    for p in pings:
        body = b"".join(bytes(fill(PART, PART_OF, fields)) + raw for fields, raw in p["parts"])
        packet = fill(PACKET, PING, {**p, "channels": len(p["parts"]), "length": PACKET + len(body)})
        struct.pack_into("<H", packet, 0, MAGIC)
        out += packet + body
    return bytes(out)


def read(spark: SparkSession, path: str | list[str], split: int = files.SPLIT, wanted: files.Wanted = files.Wanted()) -> DataFrame:
    """Pings of XTF files by byte ranges: wanted.kind(), error and path; samples are little-endian (for son.samples: big=False)."""
    return files.read(spark, path, "xtf", split, wanted)


class XtfSource(files.RangeSource):
    form = "xtf"
