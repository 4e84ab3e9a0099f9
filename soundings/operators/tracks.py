"""Transects, chunks, missing pings and track geometry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.stored import written
from ..functions.windows import KEYS, along, by_kernel, fill_linear, run_id, span_of, time_spans, unwrap
from . import kernels


def transects(pings: DataFrame, nchunk: int, index: str = "index", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """transect: runs of consecutive index; chunk_id: pieces of nchunk rows, numbered through all transects of the beam."""
    df = pings.withColumn("transect", run_id(F.col(index), along(keys, index)).cast("int"))
    df = df.withColumn("_p", ((F.row_number().over(Window.partitionBy(*keys, "transect").orderBy(index)) - 1) / nchunk).cast("int"))
    return df.withColumn("chunk_id", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("transect", "_p")) - 1).cast("int")).drop("_p")


def chunks(pings: DataFrame, nchunk: int, keys: tuple[str, ...] = KEYS, order: str = "record_num") -> DataFrame:
    """chunk_id by position; a last chunk of at most half nchunk rows joins the one before it."""
    whole = Window.partitionBy(*keys)
    df = pings.withColumn("_i", F.row_number().over(along(keys, order)) - 1).withColumn("_n", F.count("*").over(whole))
    tail = F.expr(f"_n % {nchunk}")
    last = F.greatest(F.expr(f"(_n - 1) div {nchunk}") - F.when((tail > 0) & (tail <= nchunk / 2), 1).otherwise(0), F.lit(0))
    return df.withColumn("chunk_id", F.least(F.expr(f"_i div {nchunk}"), last).cast("int")).drop("_i", "_n")


def missing_pings(pings: DataFrame, beams: list[str], reference_mode: bool = False, size: int = 250_000) -> DataFrame:
    """Rows in record order form cycles; a cycle ends when a beam comes again. A beam absent from a cycle gets a row without data.

    reference_mode leaves out the last cycle of each recording. A recording is cut into blocks
    of about `size` rows by record number. A block tells, for each place where its first new
    cycle may start, how many cycles follow and which beams the last of them has; these short
    rows are put together recording by recording, and each block numbers its cycles from what
    the blocks before it leave. Rows of one record number are in one block. Python gets many short
    blocks at once, as sorted rows, not a call for each.
    """
    ids = pings.select("rec_id", "beam", "record_num")
    s = ids.schema
    rec, beam, num = (s[c].dataType.simpleString() for c in ids.columns)
    cuts = time_spans(ids, "record_num", size)
    ids = ids.withColumns({"rec_id": F.col("rec_id").cast("string"), "block": span_of(F.col("record_num"), cuts, first=True)})
    order = ["rec_id", "block", "first", "record_num", "beam"]

    def told(t: pd.DataFrame, ends: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
        cycles, last = kernels.cycles_from(ends, bounds)
        names, out = t["beam"].to_numpy(object), []
        for lo, hi, r, block in zip(bounds[:-1].tolist(), bounds[1:].tolist(), t["rec_id"].to_numpy(object)[bounds[:-1]], t["block"].to_numpy()[bounds[:-1]]):
            first = int(ends[lo])
            at = range(lo, min(first + 1, hi))  # where the first new cycle may start
            out.append((r, block, list(names[lo:first]), [int(cycles[i]) for i in at], [list(names[last[i] : hi]) for i in at]))
        return pd.DataFrame(out, columns=["rec_id", "block", "head", "cycles", "tails"])

    def number(t: pd.DataFrame, ends: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
        """The first row of a block tells what those before it leave, if there are any."""
        names, told_, steps = t["beam"].to_numpy(object), t["first"].to_numpy() == 0, ends.tolist()
        seen, base, starts = t["seen"].to_numpy(object), t["base"].to_numpy(), np.zeros(len(t), np.int64)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = lo
            if told_[lo]:
                at, held = lo + 1, set(seen[lo])
                if at < hi:
                    at = next((i for i in range(at, steps[at]) if names[i] in held), steps[at])
                starts[lo] = base[lo]
            else:
                at = steps[lo]
            while at < hi:
                starts[at] = 1
                at = steps[at]
        runs = np.cumsum(starts)
        cycle = runs - np.repeat((runs - starts)[bounds[:-1]], np.diff(bounds))
        return t.assign(cycle=cycle)[~told_][["rec_id", "beam", "record_num", "cycle"]]

    def together(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen, base = object(), set(), 0
        for part in blocks:
            out = []
            for r in part.itertuples():
                if r.rec_id != now:
                    now, seen, base = r.rec_id, set(), 0
                out.append((r.rec_id, r.block, list(seen), base))
                head = list(r.head)
                at = next((i for i, b in enumerate(head) if b in seen), len(head))
                if at < len(r.cycles):
                    base, seen = base + int(r.cycles[at]), set(r.tails[at])
                else:
                    seen = seen | set(head)  # no beam comes again in this block
            yield pd.DataFrame(out, columns=["rec_id", "block", "seen", "base"])

    rows = ids.withColumns({"first": F.lit(1), "seen": F.lit(None).cast(f"array<{beam}>"), "base": F.lit(0).cast("long")})
    if cuts:
        dealt = rows.repartition("rec_id", "block").sortWithinPartitions(*order)
        blocks = dealt.mapInPandas(_in_groups(told), f"rec_id string, block int, head array<{beam}>, cycles array<long>, tails array<array<{beam}>>")
        left = blocks.repartition("rec_id").sortWithinPartitions("rec_id", "block").mapInPandas(together, f"rec_id string, block int, seen array<{beam}>, base long")
        rows = rows.unionByName(left.withColumns({"first": F.lit(0), "beam": F.lit(None).cast(beam), "record_num": F.lit(0).cast(num)}))
    cyc = rows.repartition("rec_id", "block").sortWithinPartitions(*order).mapInPandas(_in_groups(number), f"rec_id string, beam {beam}, record_num {num}, cycle long").withColumn("rec_id", F.col("rec_id").cast(rec))
    if cuts:
        cyc = written(cyc, "cycles")  # read twice below
    if reference_mode:
        cyc = cyc.withColumn("_m", F.max("cycle").over(Window.partitionBy("rec_id"))).where("cycle < _m").drop("_m")
    full = cyc.groupBy("rec_id", "cycle").agg(F.min("record_num").alias("_first")).withColumn("beam", F.explode(F.array(*map(F.lit, beams))))
    have = pings.join(cyc, ["rec_id", "beam", "record_num"])
    return full.join(have, ["rec_id", "cycle", "beam"], "left").withColumn("record_num", F.coalesce("record_num", "_first")).drop("_first")


def _in_groups(run: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run() over whole groups of (rec_id, block), as many at once as a batch of sorted rows holds, with the ends of cycles and the bounds of groups.

    The last group of a batch waits for the next, so a task holds a batch and a block.
    """

    def several(t: pd.DataFrame, bounds: np.ndarray) -> pd.DataFrame:
        bounds = np.append(bounds, len(t))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        told = t["first"].to_numpy() == 0
        codes = pd.factorize(t["beam"], use_na_sentinel=False)[0]
        codes = np.where(told, codes.max() + 1, codes)
        ends = kernels.cycle_ends(group * (codes.max() + 1) + codes)
        return run(t, np.minimum(ends, bounds[1:][group]), bounds)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in parts:
            if not len(part):
                continue
            key = pd.concat([h.iloc[-1:] for h in held[-1:]] + [part])[["rec_id", "block"]]
            new = (key["block"] != key["block"].shift()) | ((key["rec_id"] != key["rec_id"].shift()) & ~(key["rec_id"].isna() & key["rec_id"].shift().isna()))
            cut = np.flatnonzero(new.to_numpy()[1 if held else 0 :])
            if held and not len(cut):
                held.append(part)
                continue
            if held and cut[0] > 0:
                held.append(part.iloc[: cut[0]])
            if held:
                yield several(pd.concat(held, ignore_index=True), np.array([0]))
            if len(cut) > 1:
                yield several(part.iloc[cut[0] : cut[-1]].reset_index(drop=True), cut[:-1] - cut[0])
            held = [part.iloc[cut[-1] :]]
        if held:
            yield several(pd.concat(held, ignore_index=True), np.array([0]))

    return batches


def completed(pings: DataFrame, beams: list[str], keys: tuple[str, ...] = ("rec_id", "cycle")) -> DataFrame:
    """A row for each of `beams` in each cycle; beams that a cycle lacks get nulls, others go."""
    full = pings.select(*keys).distinct().withColumn("beam", F.explode(F.array(*map(F.lit, beams))))
    return full.join(pings, [*keys, "beam"], "left")


def bearings(pings: DataFrame, keys: tuple[str, ...] = (*KEYS, "transect"), lon: str = "lon", lat: str = "lat", out: str = "cog") -> DataFrame:
    """Initial bearing to the next ping; the last ping repeats the one before it."""
    w = along(keys)
    df = pings.withColumn(out, geo.bearing(F.col(lon), F.col(lat), F.lead(lon).over(w), F.lead(lat).over(w)))
    return df.withColumn(out, F.coalesce(out, F.lag(out).over(w)))


def offset(pings: DataFrame, along_m: float, across_m: float, bearing: str = "cog") -> DataFrame:
    """lon and lat shifted along the course, then across it."""
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), F.col(bearing), F.lit(float(along_m)), geo.R_OFFSET)
    df = pings.withColumns({"lon": lon, "lat": lat})
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), F.col(bearing) + 90, F.lit(float(across_m)), geo.R_OFFSET)
    return df.withColumns({"lon": lon, "lat": lat})


def range_edges(pings: DataFrame, bearing: str = "cog", keys: tuple[str, ...] = KEYS, sane: DataFrame | None = None) -> DataFrame:
    """range_m (modal ping_cnt times modal pixM of the chunk's pings, or of those in `sane`), ping_bearing (+90 on starboard, -90 on port), range_lon, range_lat."""
    of = (pings if sane is None else sane).groupBy(*keys, "chunk_id").agg((F.mode("ping_cnt", True) * F.mode("pixM", True)).alias("range_m"))
    df = pings.join(of, [*keys, "chunk_id"])
    df = df.withColumn("ping_bearing", F.pmod(F.col(bearing) + F.when(F.col("beam").startswith("ss_port"), -90.0).otherwise(90.0), F.lit(360.0)))
    lon, lat = geo.destination(F.col("lon"), F.col("lat"), F.col("ping_bearing"), F.col("range_m"))
    return df.withColumns({"range_lon": lon, "range_lat": lat})


def smooth(pings: DataFrame, keep_every: int = 10, keys: tuple[str, ...] = (*KEYS, "transect"), x: str = "e", y: str = "n") -> DataFrame:
    """x_s, y_s: interpolating splines by time through every keep_every-th distinct position and the last one, at every ping. Only times and positions meet in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        some = part.dropna(subset=[x, y, "time_s"]).drop_duplicates([x, y])
        knots = some.iloc[sorted({*range(0, len(some), keep_every), len(some) - 1})] if len(some) else some
        t, at = knots["time_s"].to_numpy(float), part["time_s"].to_numpy(float)
        if len(np.unique(at)) < len(at):  # equal times: spread by record number
            t, at = t * knots["record_num"].to_numpy(float), at * part["record_num"].to_numpy(float)
        if not (np.diff(at) > 0).all():
            t, at = knots["record_num"].to_numpy(float), part["record_num"].to_numpy(float)
        good = len(t) > 1 and (np.diff(t) > 0).all()
        for c, o in ((x, "x_s"), (y, "y_s")):
            part[o] = kernels.spline(t, knots[c].to_numpy(float), at) if good else part[c].astype(float)
        return part

    return by_kernel(pings, keys, "record_num", ("record_num", "time_s", x, y), {"x_s": "double", "y_s": "double"}, run)


def smooth_heading(pings: DataFrame, column: str = "instr_heading", window: int = 51, keys: tuple[str, ...] = (*KEYS, "transect")) -> DataFrame:
    """heading_s: the unwrapped heading smoothed by a cubic Savitzky-Golay window, modulo 360; tracks under one window stay as they are."""
    df = unwrap(pings, column, along(keys), "_u")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        v = part["_u"].astype(float).interpolate(limit_direction="both").to_numpy()
        part["heading_s"] = (kernels.savgol(v, window) if len(v) >= window else v) % 360
        return part

    return by_kernel(df, keys, "record_num", ("record_num", "_u"), {"heading_s": "double"}, run).drop("_u")


def overlaps(pings: DataFrame, keys: tuple[str, ...] = (*KEYS, "chunk_id"), reference_mode: bool = False, every: int = 1) -> DataFrame:
    """overlap: whether a ping's line from track (e, n) to range edge (range_e, range_n) crosses that of an earlier ping of its chunk.

    With every > 1 only each `every`-th ping of the chunk and its last are compared, in order: pings marked already
    mark no others, and the last is kept in place of what it crosses. reference_mode marks none. A chunk has a fixed
    number of pings, so the pairs per ping are bounded.
    """
    if reference_mode:
        return pings.withColumn("overlap", F.lit(False))
    at = pings.withColumn("_i", F.row_number().over(along(keys)))
    lines = at.select(*keys, "_i", "e", "n", "range_e", "range_n", "range_m")
    if every > 1:
        lines = lines.withColumn("_last", F.max("_i").over(Window.partitionBy(*keys))).where(((F.col("_i") - 1) % every == 0) | (F.col("_i") == F.col("_last")))
    b = lines.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("_i").alias("_j"), *(F.col(c).alias(f"_b_{c}") for c in ("e", "n", "range_e", "range_n", "range_m")))
    same = [lines[k].eqNullSafe(b[f"_b_{k}"]) for k in keys]
    near = lines.join(b, [*same, b["_j"] > lines["_i"], geo.distance(lines["e"], lines["n"], b["_b_e"], b["_b_n"]) <= lines["range_m"] + b["_b_range_m"]])
    hit = near.where(geo.segments_cross(*(F.col(c) for c in ("e", "n", "range_e", "range_n", "_b_e", "_b_n", "_b_range_e", "_b_range_n"))))
    if every > 1:
        hit = hit.select(*keys, "_i", "_j", "_last").groupBy(*keys).applyInPandas(_drop_in_order(keys), ", ".join(f"{k} {pings.schema[k].dataType.simpleString()}" for k in keys) + ", _i int")
    else:
        hit = hit.select(*keys, F.col("_j").alias("_i")).distinct()
    hit = hit.withColumn("overlap", F.lit(True))
    return at.join(hit, [*keys, "_i"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False))).drop("_i")


def _drop_in_order(keys: tuple[str, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        last, out = pairs["_last"].iloc[0], set()
        for i, crossed in pairs.sort_values("_i").groupby("_i")["_j"]:
            if i not in out:
                out |= {i if j == last else j for j in crossed}
        return pd.DataFrame({**{k: [pairs[k].iloc[0]] * len(out) for k in keys}, "_i": sorted(out)})

    return run


def patch_seams(pings: DataFrame, columns: tuple[str, ...] = ("e", "n"), keys: tuple[str, ...] = (*KEYS, "transect")) -> DataFrame:
    """The first ping of a chunk takes the position of the second-last ping of the chunk before it in its transect."""
    w = along(keys)
    first = F.col("chunk_id") != F.lag("chunk_id").over(w)
    return pings.withColumns({c: F.when(first & F.lag(c, 2).over(w).isNotNull(), F.lag(c, 2).over(w)).otherwise(F.col(c)) for c in columns})


def renumber(pings: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Chunk ids made dense after some have gone."""
    return pings.withColumn("chunk_id", (F.dense_rank().over(Window.partitionBy(*keys).orderBy("chunk_id")) - 1).cast("int"))


def sane_projection(pings: DataFrame, lon: str = "lon", lat: str = "lat", e: str = "e", n: str = "n") -> DataFrame:
    """e and n computed anew from lon and lat where null, not positive or (e) above 1e6."""
    x, y = geo.utm(F.col(lon), F.col(lat))
    bad = F.coalesce((F.col(e) <= 0) | (F.col(e) > 1e6) | (F.col(n) <= 0), F.lit(True))
    return pings.withColumn("_bad", bad).withColumns({e: F.when(F.col("_bad"), x).otherwise(F.col(e)), n: F.when(F.col("_bad"), y).otherwise(F.col(n))}).drop("_bad")


def crop_range(pings: DataFrame, metres: float) -> DataFrame:
    return pings.withColumn("ping_cnt", F.least(F.col("ping_cnt"), F.bround(metres / F.col("pixM")).cast("int"))) if metres > 0 else pings


def longest_beam(pings: DataFrame) -> DataFrame:
    """rec_id, beam with most pings (ties: the first name)."""
    n = pings.groupBy(*KEYS).agg(F.count("*").alias("k"))
    return n.groupBy("rec_id").agg(F.min_by("beam", F.struct(-F.col("k"), F.col("beam"))).alias("beam"))


def is_side(beam: Column) -> Column:
    return beam.startswith("ss_port") | beam.startswith("ss_star")


def side_key(beam: Column) -> Column:
    """The frequency suffix of a side-scan beam ('default' without one), null for others."""
    return F.when(is_side(beam), F.coalesce(F.nullif(F.regexp_extract(beam, r"^ss_(?:port|star)_?(.*)$", 1), F.lit("")), F.lit("default")))


def side_pairs(beams: DataFrame) -> DataFrame:
    """rec_id, key, port, star: beams of each frequency; a missing side is null."""
    df = beams.withColumn("key", side_key(F.col("beam"))).where("key IS NOT NULL").withColumn("side", F.when(F.col("beam").startswith("ss_port"), "port").otherwise("star"))
    return df.groupBy("rec_id", "key").pivot("side", ["port", "star"]).agg(F.min("beam"))


def profile(pings: DataFrame, columns: list[str]) -> DataFrame:
    """column, least, most, mean, valid: one row per column; valid where some value is above 0."""
    stats = pings.agg(*(f(F.col(c).cast("double")).alias(f"{c}__{n}") for c in columns for n, f in (("least", F.min), ("most", F.max), ("mean", F.avg))))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{c}__{n}").alias(n) for n in ("least", "most", "mean"))) for c in columns))
    return stats.select(F.inline(rows)).withColumn("valid", F.coalesce(F.col("most") > 0, F.lit(False)))


def beam_duplicate(pings: DataFrame) -> DataFrame:
    """A recording with one side only gets a copy of it as the other side, with export false."""
    one = pings.where(is_side(F.col("beam"))).groupBy("rec_id").agg(F.min("beam").alias("_b"), F.countDistinct("beam").alias("_k")).where("_k = 1")
    copy = pings.join(one, [pings["rec_id"] == one["rec_id"], pings["beam"] == one["_b"]]).drop(one["rec_id"])
    other = F.when(F.col("_b").startswith("ss_port"), F.regexp_replace("_b", "^ss_port", "ss_star")).otherwise(F.regexp_replace("_b", "^ss_star", "ss_port"))
    return pings.withColumn("export", F.lit(True)).unionByName(copy.withColumn("beam", other).drop("_b", "_k").withColumn("export", F.lit(False)))


def relinearise(pings: DataFrame, every: int = 50, keys: tuple[str, ...] = (*KEYS, "chunk_id"), columns: tuple[str, ...] = ("range_e", "range_n")) -> DataFrame:
    """columns linear between every `every`-th ping of a chunk (and its last), leaving out pings marked `overlap`; the row count stays."""
    w = along(keys)
    kept = ~F.col("overlap") if "overlap" in pings.columns else F.lit(True)
    df = pings.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    df = df.withColumn("_knot", kept & ((F.col("_i") % every == 0) | (F.col("_i") == F.col("_n") - 1)))
    for c in columns:
        df = fill_linear(df, c, keys, "record_num", "_f", F.col("_knot")).withColumn(c, F.coalesce("_f", c)).drop("_f")
    return df.drop("_i", "_n", "_knot")
