"""Mixing sources to target weights by a low-discrepancy source schedule (DataFrame operations only).

1. targets(): each source's share of all words by weight, at most `most` times what it
   has; the excess goes to the others by weight (a water level, found in one ordered pass).
2. schedule(): slot n gets the golden-ratio point frac(n * 0.618...), which the cumulative
   shares map to a source; slots are ranked within their source in slot order.
3. A source's documents, shuffled by hash, form a stream that repeats for up to `most`
   passes. The stream is cut into as many blocks of equal words (to one word) as the source
   has slots; block j fills the source's slot of rank j.

Every source thereby gives its target to the word, and the order of slots keeps each
prefix of the mix near the weights. Ranks and running sums come in two levels (per chunk,
then over chunks), so no task holds a whole source. Windows over sources alone (the water
level, the cumulative shares) meet in one task with one narrow row for each distinct source.

Texts are never shuffled: mix() reads them once for their sizes, and mixed(), which returns
whole documents, finds in the mix where each source's stream stops and reads them once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import remove, written

WORD = r"[^\x20\x09-\x0D]+"
#: floor(2**32 / golden ratio), odd: multiples of it modulo 2**32 are the golden-ratio sequence.
STEP, TURN = 2654435769, 4294967296
CELLS = 1024
CHUNK = 65536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """Sources as non-null keys; null sorts after every other ('=' < '~')."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def _hash(doc_id: Column, seed: str) -> Column:
    """The shuffling hash: a source's stream is in its order."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, skey, size, h (shuffling hash), bucket (its first 12 bits); one pass over the texts."""
    return docs.select("doc_id", _key(F.col("source").cast("string")).alias("skey"), n_words(F.col("text")).alias("size"), _hash(F.col("doc_id"), seed).alias("h")).withColumn(
        "bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """skey, size -> with w, target (double) and words (target to the nearest word).

    One window over the distinct sources, not over rows. Where weights would give a source
    more than `most` times its size it gets just that; sorted by size per weight, those
    sources come first, so the level of the rest follows from running sums.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy("skey")) - 1, F.lit(len(weights)))
    ranked = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")).withColumn("cap", F.col("size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    full = F.col("cap").cast("double") <= F.col("level") * F.col("w")
    first = F.first(F.when(~full, F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        ranked.withColumn("level", level)
        .withColumn("at", first)
        .withColumn("target", F.when(full | F.col("at").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("at") * F.col("w"), F.col("cap").cast("double"))))
        .withColumn("words", F.round("target").cast("long"))
        .select("skey", "size", "w", "target", "words")
    )


def schedule(goals: DataFrame, n_slots: int) -> DataFrame:
    """slot, skey, rank, slots (of the source): the golden-ratio sequence through cumulative targets.

    Points meet their source by an equi-join on 1,024 cells of [0, 1) plus the interval test.
    Sources with words to give but no slot get one at the end.
    """
    spark = goals.sparkSession
    some = goals.where("words > 0")
    upto = F.sum("words").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("words").over(Window.partitionBy())
    spans = (
        some.withColumn("hi", upto / every).withColumn("lo", (upto - F.col("words")) / every)
        .select("skey", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    )
    point = F.pmod(F.col("id") * F.lit(STEP), F.lit(TURN)).cast("double") / F.lit(float(TURN))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    hit = points.join(spans, "cell").where("x >= lo AND x < hi").select("slot", "skey", (F.col("slot") / CHUNK).cast("long").alias("chunk"))
    bare = some.select("skey").join(hit.select("skey").distinct(), "skey", "left_anti").select(F.lit(n_slots).cast("long").alias("slot"), "skey", F.lit(n_slots // CHUNK).cast("long").alias("chunk"))
    hit = hit.unionByName(bare)
    sums = hit.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).withColumn("slots", F.sum("n").over(Window.partitionBy("skey")))
    rank = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1
    return hit.withColumn("r", rank).join(sums, ["skey", "chunk"]).select("slot", "skey", (F.col("r") + F.col("ahead")).alias("rank"), "slots")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 4096, seed: str = "mix") -> DataFrame:
    """One row per input row: doc_id, skey (the source as a key), source_size, size, target, taken, n_slots, first_slot.

    taken: words of the document in the mix, repeats counted; first_slot: where the mix first
    reads it. block_words sets the grain of the schedule (at most 3.4e9 slots).

    Null text or text without words: size 0, taken 0. Null source: a source of its own, last.
    Repeated rows and doc_ids: each row takes its own place in the stream. Empty table: no
    rows. Other columns are ignored.
    """
    return _taken(docs, weights, most, block_words, seed)[0].drop("h")


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, block_words: int, seed: str) -> tuple[DataFrame, list[DataFrame]]:
    """mix() with h, and the tables it reads."""
    rows = written(sized(docs, seed), "mix-sized")
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("k"))
    goals = written(targets(sums.groupBy("skey").agg(F.sum("n").alias("size")), weights, most), "mix-goals")
    total = goals.agg(F.sum("words")).first()[0] or 0
    if total // block_words >= 3_400_000_000:
        raise ValueError("block_words is too small for this many words")
    slots = written(schedule(goals, max(1, -(-total // block_words))), "mix-slots")
    n_slots = slots.groupBy("skey").agg(F.first("slots").alias("slots"))
    plan = (
        sums.withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .withColumn("index", F.coalesce(F.sum("k").over(ahead), F.lit(0)))
        .join(goals.withColumnRenamed("size", "source_size"), "skey")
        .join(n_slots, "skey", "left")
        .select("skey", "bucket", "start", "index", "source_size", "target", "words", F.coalesce("slots", F.lit(1)).alias("slots"))
        .withColumn("q", F.expr("words div slots"))
        .withColumn("r", F.expr("words % slots"))
    )
    w = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size")
    laid = (
        rows.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("i", F.row_number().over(w))
        .join(plan, ["skey", "bucket"])
        .withColumn("a", F.col("start") + F.col("upto") - F.col("size"))
        .withColumn("i", F.col("index") + F.col("i"))
    )
    block = lambda p: F.expr(f"CASE WHEN {p} < r * (q + 1) THEN {p} div (q + 1) ELSE r + ({p} - r * (q + 1)) div greatest(q, 1L) END")
    parts = (
        laid.where("size > 0 AND words > 0")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
        .withColumn("from", F.col("a") + F.col("pass") * F.col("source_size"))
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("words")))
        .where("from < to")
        .withColumn("last", F.expr("to - 1"))
        .withColumn("rank", F.explode(F.sequence(block("from"), block("last"))))
        .withColumn("b0", F.expr("rank * q + least(rank, r)"))
        .withColumn("b1", F.expr("(rank + 1) * q + least(rank + 1, r)"))
        .select("skey", "i", "rank", F.expr("least(to, b1) - greatest(from, b0)").alias("n"))
    )
    got = (
        parts.join(slots.select("skey", "rank", "slot"), ["skey", "rank"])
        .groupBy("skey", "i")
        .agg(F.sum("n").alias("taken"), F.count("*").alias("n_slots"), F.min("slot").alias("first_slot"))
    )
    out = laid.join(got, ["skey", "i"], "left").select(
        "doc_id", "h", "skey", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), "first_slot"
    )
    return out, [rows, goals, slots]


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 4096, seed: str = "mix") -> DataFrame:
    """docs, each row as often as the mix takes the whole of it, to the nearest whole number; rows without words once.

    A source's slots read its stream from the start, some whole passes and a part of one
    more, so its documents are taken `top` times up to a last one, in the order of the
    stream, and `base` times from there. One row per source (base, top, that document's
    hash) therefore tells every document's copies, and rows with texts meet only that.

    Rows of one source with equal doc_id share what the mix takes of them evenly. Null
    sources are one source; null and empty texts and blank ones have no words; an empty table
    stays empty; all columns are kept.
    """
    took, tables = _taken(docs, weights, most, block_words, seed)
    each = took.where("size > 0").groupBy("skey", "h").agg(F.round(F.sum("taken") / F.sum("size")).cast("int").alias("copies"))
    stops = each.groupBy("skey", "copies").agg(F.max("h").alias("h")).groupBy("skey").agg(F.min("copies").alias("base"), F.max("copies").alias("top"), F.max_by("h", "copies").alias("stop"))
    stops = written(stops, "mix-stops")
    for table in tables:
        remove(table)
    keyed = docs.select(F.struct("*").alias("row"), _key(docs["source"].cast("string")).alias("skey"), _hash(docs["doc_id"], seed).alias("h"), F.coalesce(docs["text"].rlike(WORD), F.lit(False)).alias("some"))
    copies = F.when(~F.col("some"), 1).otherwise(F.when(F.col("h") <= F.col("stop"), F.col("top")).otherwise(F.col("base")))
    found = keyed.join(stops, "skey", "left").select("row", F.coalesce(copies, F.lit(0)).alias("copies")).where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
