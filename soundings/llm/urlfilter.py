"""URL filters: host and path rules, and exact list membership by a Bloom filter cascade.

A cascade holds a list of keys within a known universe (every key of the corpus). Level 1
is a Bloom filter of the listed keys; level 2 one of the unlisted keys that level 1 passes
by mistake; level 3 one of the listed keys that level 2 passes; and so on until no mistake
is left. A key of the universe is listed exactly if the first level that rejects it is an
even one, or if it passes all of an odd number of levels. About 15 bits for a listed key
suffice and no page is joined with the list.

Keys are distinct and dealt to shards by hash, so shards are even however common a key is
among pages; a shard's cascade is built in one task. Filters are broadcast while they are
small (their size is measured); beyond that pages and filters stream together, sorted by
shard and salted, through a task that holds one shard's filter at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import written

KEYS_PER_SHARD = 200_000
BROADCAST_BYTES = 32 << 20
SALTS = 64
FIRST, LATER = (7, 10.1), (1, 1.44)  # hash functions and bits per key: 0.8 % mistakes at level 1, a half later


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; '' without ://."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _spots(h: np.ndarray, g: np.ndarray, level: int, k: int, m: int) -> np.ndarray:
    """k bit numbers below m for each key, by double hashing that differs by level."""
    with np.errstate(over="ignore"):
        a = (h ^ np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        a ^= a >> np.uint64(31)
        b = (g + np.uint64(level)) * np.uint64(0x94D049BB133111EB) | np.uint64(1)
        return ((a[:, None] + np.arange(k, dtype=np.uint64)[None] * b[:, None]) >> np.uint64(11)) % np.uint64(m)


def _passes(level: tuple, n: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    k, m, bits = level
    at = _spots(h, g, n, k, m)
    return ((np.frombuffer(bits, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def build(h: np.ndarray, g: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The levels (k, m, bits) over distinct keys given as two 64-bit hashes."""
    levels: list[tuple[int, int, bytes]] = []
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(inside):
        if len(levels) > 200:
            raise ValueError("two keys have the same 128-bit hash")
        k, per_key = LATER if levels else FIRST
        m = max(64, int(len(inside) * per_key + 7) // 8 * 8)
        bits = np.zeros(m // 8 * 8, np.uint8)
        bits[_spots(h[inside], g[inside], len(levels), k, m).ravel()] = 1
        levels.append((k, m, np.packbits(bits, bitorder="little").tobytes()))
        wrong = outside[_passes(levels[-1], len(levels) - 1, h[outside], g[outside])]
        inside, outside = wrong, inside
    return levels


def look(levels: list[tuple[int, int, bytes]], h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each key is listed; exact for keys of the universe."""
    alive, listed = np.arange(len(h)), np.zeros(len(h), bool)
    for n, level in enumerate(levels):
        ok = _passes(level, n, h[alive], g[alive])
        listed[alive[~ok]] = n % 2 == 1
        alive = alive[ok]
    listed[alive] = len(levels) % 2 == 1
    return listed


def _u64(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64).view(np.uint64)


def cascade(keys: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """keys: (key, listed boolean), all keys of the corpus. Returns (shard, levels binary) and the number of shards.

    Repeated keys count once, listed if any row says so; null keys are left out.
    """
    distinct = keys.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed"))
    hashed = written(distinct.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("g"), "key").alias("g"), "listed"), "url-keys")
    shards = max(1, -(-hashed.count() // keys_per_shard))

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "levels": [pickle.dumps(build(_u64(part["h"]), _u64(part["g"]), part["listed"].to_numpy(bool)))]})

    spread = hashed.withColumn("shard", F.pmod("g", F.lit(shards)))
    return written(spread.groupBy("shard").applyInPandas(one, "shard long, levels binary"), "url-cascade"), shards


def member(rows: DataFrame, key: str, filters: DataFrame, shards: int, out: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with a boolean column `out`: whether `key` (null: false) is in the cascade's list."""
    size = filters.agg(F.sum(F.octet_length("levels"))).first()[0] or 0
    hashes = F.xxhash64(key), F.xxhash64(F.lit("g"), key)
    if size <= broadcast_bytes:
        held = rows.sparkSession.sparkContext.broadcast({r["shard"]: r["levels"] for r in filters.collect()})

        @F.pandas_udf("boolean")
        def listed(h: pd.Series, g: pd.Series) -> pd.Series:
            a, b = _u64(h), _u64(g)
            found, home = np.zeros(len(a), bool), (g.to_numpy(np.int64) % shards)
            for s in np.unique(home):
                if s in held.value:
                    at = home == s
                    found[at] = look(pickle.loads(held.value[s]), a[at], b[at])
            return pd.Series(found)

        return rows.withColumn(out, F.col(key).isNotNull() & listed(*hashes))
    return _streamed(rows, key, filters, shards, out)


def _streamed(rows: DataFrame, key: str, filters: DataFrame, shards: int, out: str) -> DataFrame:
    """member() without a broadcast: rows, packed as structs, follow their shard's filter in one sorted stream; a shard is salted."""
    row = F.struct("*")
    kind = rows.select(row.alias("r")).schema["r"].dataType
    home = F.coalesce(F.pmod(F.xxhash64(F.lit("g"), key), F.lit(shards)), F.lit(0).cast("long"))
    pages = rows.select(
        home.alias("shard"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"), F.lit(1).alias("o"), F.lit(None).cast("binary").alias("levels"),
        F.xxhash64(key).alias("h"), F.xxhash64(F.lit("g"), key).alias("g"), F.col(key).isNotNull().alias("some"), row.alias("r"),
    )
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    each = filters.select("shard", salts.alias("salt"), F.lit(0).alias("o"), "levels", *(F.lit(0).cast("long").alias(c) for c in "hg"), F.lit(False).alias("some"), F.lit(None).cast(kind).alias("r"))
    stream = pages.unionByName(each).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "o")

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, levels = None, []
        for b in batches:
            shard, salt, o, h, g, some = (np.asarray(b.column(c)) if c != "some" else b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "salt", "o", "h", "g", "some"))
            h, g = h.astype(np.int64).view(np.uint64), g.astype(np.int64).view(np.uint64)
            found = np.zeros(b.num_rows, bool)
            turn = np.flatnonzero((shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1])) + 1
            for x, y in zip([0, *turn], [*turn, b.num_rows]):
                if x == y:
                    continue
                if (shard[x], salt[x]) != at:
                    at, levels = (shard[x], salt[x]), []
                if o[x] == 0:
                    levels = pickle.loads(b.column("levels")[int(x)].as_py())
                found[x:y] = look(levels, h[x:y], g[x:y])
            mine = pa.array(o == 1)
            yield pa.RecordBatch.from_arrays([b.column("r").filter(mine), pa.array(found & some).filter(mine)], ["r", "found"])

    found = stream.mapInArrow(flow, T.StructType([T.StructField("r", kind), T.StructField("found", T.BooleanType())]))
    return found.select("r.*", F.col("found").alias(out))


def sizes(filters: DataFrame) -> DataFrame:
    """level, shards, hashes (bit positions per key), bits: the cascade's size by level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(n + 1, k, m) for x in part["levels"] for n, (k, m, _) in enumerate(pickle.loads(x))]
            yield pd.DataFrame(rows, columns=["level", "hashes", "bits"])

    each = filters.select("levels").mapInPandas(run, "level int, hashes int, bits long")
    return each.groupBy("level").agg(F.count("*").alias("shards"), F.max("hashes").alias("hashes"), F.sum("bits").alias("bits"))


def link_farms(pages: DataFrame, most: int = 5) -> DataFrame:
    """key: hosts whose pages together hold more than `most` links (`<a `) for each 1,000 code points of HTML. Null HTML counts as empty."""
    html = F.coalesce(F.col("html"), F.lit(""))
    links = F.floor((F.length(html) - F.length(F.replace(html, F.lit("<a "), F.lit("")))) / 3)
    told = pages.select(host(F.col("url")).alias("key"), links.alias("links"), F.length(html).cast("long").alias("n")).where("key <> ''")
    return told.groupBy("key").agg(F.sum("links").alias("links"), F.sum("n").alias("n")).where(F.col("links") * 1000 > F.col("n") * most).select("key")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], block_list: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, in_list: the rule's verdict, else 'block' for hosts in block_list (key), else 'allow'.

    The list meets the distinct hosts of the corpus once, when the cascade is built; pages meet
    the cascade alone. Repeated and null keys of the list, and those that no page has, change
    nothing. Null url or one without ://: host and path are '', which no rule fits and no list
    holds; urls of any length are read whole. Repeated rows are judged each; an empty table
    gives no rows, an empty list blocks nothing; other columns are ignored.
    """
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    hosts = parts.where("host <> ''").select(F.col("host").alias("key")).distinct()
    listed = block_list.select("key", F.lit(True).alias("listed")).distinct()
    filters, shards = cascade(hosts.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    said = member(parts, "host", filters, shards, "in_list")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return said.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("in_list"), "block").otherwise("allow"))).select("page_id", "host", "path", "rule", "verdict", "in_list")
