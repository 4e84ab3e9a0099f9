"""K-d tree sharding by bytes (DataFrame operations only).

Documents form units: rows of equal text, which therefore share a shard. Only a group that
outweighs a whole shard (total bytes / shards) cannot, and is cut into hashed parts of a
hundredth of a shard. A unit has coordinates in metadata space (text size, source, language,
doc_id), each 24 bits, and every coordinate carries a 24-bit hash of the unit below it, so
that rows with equal metadata can still be told apart.

The tree is grown a level at a time. One aggregation gives each node's bytes and extent;
the node is split along its widest dimension at the weighted quantile that leaves both
sides whole numbers of target-size leaves. Units above a hundredth of a shard, at most 100
for each shard in number, are split at their own weighted quantile on the driver, and the
cut of all other units is set so that it makes up for what these leave uneven. That
cut is exact: four aggregations narrow the 48-bit key by 12 bits each. Only cuts (one per
node) and heavy units reach the driver; the finished tree is a CASE expression, so a
document's shard needs no lookup beyond its unit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import remove, written

BITS = 24
DIMS = ("d_size", "d_source", "d_lang", "d_id")
PARTS_OF_SHARD = 100  # units above this part of a shard are heavy


def _hash24(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 64 - BITS)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size, crc, th (text hash): one pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang")}
    return docs.select(
        "doc_id", *(c.alias(n) for n, c in have.items()), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.xxhash64("text").alias("th")
    )


def units_of(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame, int]:
    """rows with their part number; the units: th, part, w (bytes), one 48-bit key per dimension; the weight above which units are heavy."""
    stats = rows.agg(F.sum("size").alias("t"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    total, lo, hi = stats["t"] or 0, float(stats["lo"] or 0), float(stats["hi"] or 0)
    grain = max(1, total // (shards * PARTS_OF_SHARD))
    # Fewer than `shards` groups are heavier than a shard: this broadcast has a proven bound.
    large = rows.groupBy("th", "size").agg(F.sum("size").alias("b"), F.count("*").alias("k")).where((F.col("b") * shards > total) & (F.col("k") > 1))
    large = large.select("th", "size", F.ceil(F.col("b") / grain).alias("parts"))
    parted = rows.join(F.broadcast(large), ["th", "size"], "left").withColumn("part", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("parts")))).drop("parts")
    units = parted.groupBy("th", "size", "part").agg(F.sum("size").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("doc_id").alias("id"))
    top = float(2**BITS - 1)
    whole = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(top)).cast("long")
    at = {
        "d_size": whole(F.log2(F.col("size").cast("double")) / 40 * top),
        "d_source": F.coalesce(_hash24(F.col("source")), F.lit(0)),
        "d_lang": F.coalesce(_hash24(F.col("lang")), F.lit(0)),
        "d_id": whole((F.coalesce(F.col("id").cast("double"), F.lit(lo)) - lo) / max(hi - lo, 1.0) * top),
    }
    tie = _hash24(F.col("th"), F.col("size"), F.col("part"), F.lit("tie"))
    return parted, units.select("th", "size", "part", "w", *((at[d] * (1 << BITS) + tie).alias(d) for d in DIMS)), grain


@dataclass
class Node:
    """shards first .. first + n - 1 with their heavy units; once split: dim and the largest key of the left side."""

    first: int
    n: int
    heavy: list = field(default_factory=list)
    dim: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def column(node: Node) -> Column:
    """The tree as a column: the first shard of the leaf that a unit's keys fall in."""
    if node.left is None:
        return F.lit(node.first)
    return F.when(F.col(node.dim) <= node.cut, column(node.left)).otherwise(column(node.right))


def level_weights(heavy: list[dict], total: int, shards: int) -> list[dict]:
    """The heavy units, those that outweigh a shard counted as just filling one: the others share what is left."""
    full, rest = float(total) / shards, sorted((h["w"] for h in heavy), reverse=True)
    for i, w in enumerate(rest[: shards - 1]):
        if w <= full:
            break
        full = (total - sum(rest[: i + 1])) / (shards - i - 1)
    return [{**h, "w": min(float(h["w"]), full)} for h in heavy]


def halve(heavy: list[dict], dim: str, part: float) -> tuple[list[dict], list[dict]]:
    """Heavy units in order of a key, split where the weight before comes nearest to `part` of all (ties: the earlier place)."""
    heavy = sorted(heavy, key=lambda h: h[dim])
    goal, upto, best, at = part * sum(h["w"] for h in heavy), 0.0, None, 0
    for i in range(len(heavy) + 1):
        if best is None or abs(upto - goal) < best:
            best, at = abs(upto - goal), i
        if i < len(heavy):
            upto += heavy[i]["w"]
    return heavy[:at], heavy[at:]


def grow(units: DataFrame, shards: int, grain: int) -> tuple[Node, dict[tuple, int]]:
    """The tree of the light units, and the shard of each heavy one by (th, size, part)."""
    light = units.where(F.col("w") <= grain)
    heavy = [r.asDict() for r in units.where(F.col("w") > grain).collect()]  # at most 100 a shard
    total = sum(h["w"] for h in heavy) + (light.agg(F.sum("w")).first()[0] or 0)
    root = Node(0, shards, level_weights(heavy, total, shards))
    level, leaves = [root], []
    while level:
        leaves += [x for x in level if x.n == 1]
        level = [x for x in level if x.n > 1]
        if not level:
            break
        placed = light.withColumn("node", column(root)).where(F.col("node").isin([x.first for x in level]))
        ends = [f(F.shiftright(d, BITS)).alias(f"{d}_{n}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("w").alias("w"), *ends).collect()}
        want: dict[int, float] = {}
        sides = {}
        for x in level:
            got = stats.get(x.first)
            reach = {}
            for d in DIMS:
                seen = [h[d] >> BITS for h in x.heavy] + ([got[f"{d}_lo"], got[f"{d}_hi"]] if got else [])
                reach[d] = max(seen) - min(seen) if seen else 0
            x.dim = max(DIMS, key=lambda d: reach[d])
            share = (x.n // 2) / x.n
            sides[x.first] = halve(x.heavy, x.dim, share)
            bytes_, own = (got["w"] if got else 0), sum(h["w"] for h in x.heavy)
            want[x.first] = min(max((bytes_ + own) * share - sum(h["w"] for h in sides[x.first][0]), 0.0), float(bytes_))
        keyed = placed.select("node", "w", _by_node({x.first: F.col(x.dim) for x in level}).alias("key"))
        prefix = {x.first: 0 for x in level}
        below = dict.fromkeys(prefix, 0)
        last: dict[int, int] = {}
        for step in (36, 24, 12, 0):
            inside = keyed.where(F.shiftright("key", step + 12) == _by_node({k: F.lit(v) for k, v in prefix.items()}))
            bins = inside.groupBy("node", F.shiftright("key", step).alias("bin")).agg(F.sum("w").alias("w"))
            upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + _by_node({k: F.lit(v) for k, v in below.items()})
            goal = _by_node({k: F.lit(float(v)) for k, v in want.items()})
            cuts = bins.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("m")).collect()
            for r in cuts:
                prefix[r["node"]], below[r["node"]], last[r["node"]] = r["m"]["bin"], r["m"]["upto"] - r["m"]["w"], r["m"]["w"]
        below_level = []
        for x in level:
            over, under = below[x.first] + last.get(x.first, 0) - want[x.first], want[x.first] - below[x.first]
            x.cut = prefix[x.first] - (1 if over > under else 0)
            k = x.n // 2
            x.left, x.right = Node(x.first, k, sides[x.first][0]), Node(x.first + k, x.n - k, sides[x.first][1])
            below_level += [x.left, x.right]
        level = below_level
    return root, {(h["th"], h["size"], h["part"]): x.first for x in leaves for h in x.heavy}


def _placed(units: DataFrame, root: Node, heavy: dict[tuple, int]) -> DataFrame:
    """th, size, part, shard of every unit; heavy ones (a bounded number) come as one literal and are broadcast."""
    told = json.dumps([{"th": th, "size": size, "part": part, "heavy_shard": s} for (th, size, part), s in heavy.items()])
    known = units.sparkSession.range(1).select(F.inline(F.from_json(F.lit(told), "array<struct<th:long,size:long,part:long,heavy_shard:int>>")))
    return units.join(F.broadcast(known), ["th", "size", "part"], "left").select("th", "size", "part", F.coalesce("heavy_shard", column(root)).alias("shard"))


def _by_node(of: dict[int, Column]) -> Column:
    out = F.when(F.lit(False), next(iter(of.values())))
    for k, v in of.items():
        out = out.when(F.col("node") == k, v)
    return out


def shard(docs: DataFrame, shards: int = 24, buckets: int = 1024) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), source, lang.

    Shards differ in bytes by a few hundredths at most, or by one unit where a single text or
    group outweighs that. Rows of equal text share a shard, unless their bytes exceed those
    of a whole shard (total / shards); of such groups hashed parts are placed each as a whole.
    Slots number a shard's rows by hash, counted per bucket first so that no task sorts a
    whole shard.

    Null text counts as empty (crc32 0) but is a text of its own; null source, lang or
    doc_id have the lowest coordinate; repeated rows get a slot each; an empty table gives
    no rows; other columns are ignored.
    """
    rows = written(rows_of(docs), "shard-rows")
    parted, units, grain = units_of(rows, shards)
    units = written(units, "shard-units")
    placed = parted.join(_placed(units, *grow(units, shards, grain)), ["th", "size", "part"])
    placed = placed.withColumn("h", F.xxhash64("doc_id", "th")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    placed = written(placed.select("doc_id", "size", "crc", "shard", "h", "bucket", "source", "lang"), "shard-placed")
    remove(rows)
    remove(units)
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("shard", "bucket").agg(F.count("*").alias("k")).select("shard", "bucket", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("ahead"))
    r = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "source", "lang")) - 1
    return placed.withColumn("r", r).join(sums, ["shard", "bucket"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("r") + F.col("ahead")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source", "lang",
    )
