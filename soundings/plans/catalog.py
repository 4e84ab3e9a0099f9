"""Registered queries of the sonar operators and, beside each, its DuckDB equivalent.

The test tables stand in for survey data: an event is a ping (user: recording, event type:
beam, value: depth), an embedding is a sample vector, a line item an intensity pixel or a
patch of substrate. Some queries make an operator's input by a condition on a foreign column
(pings above a depth, pixels above a value, seven of a vector's components as class scores):
that is the operator's input there, every row of the table is read, and the SQL states the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.windows import as_of, fill_linear, rolling_median, unwrap
from . import survey
from ..operators import depth, egn, filters, mosaic, overlay, reach, regions, samples, substrate, tracks, waterfall

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

P = """WITH p AS (SELECT user_id AS rec_id, event_type AS beam, event_id AS record_num, event_id AS index,
 epoch_us(ts) / 1e6 AS time_s, value AS dep_m, value * 0.9e0 AS inst_dep_m, (value * 7.3e0) % 360e0 AS instr_heading, value / 25e0 AS speed_ms,
 -90e0 + (event_id % 1000) * 0.001e0 AS lon, 30e0 + value * 0.0001e0 AS lat, (event_id % 1000) * 1.5e0 AS e, value * 2e0 AS n,
 CAST(100 + event_id % 50 AS INTEGER) AS ping_cnt, 0.05e0 AS pixM, event_id * 0.5e0 AS trk_dist FROM events)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pings(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("rec_id"), F.col("event_type").alias("beam"), i.alias("record_num"), i.alias("index"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(ts AS TIMESTAMP_NTZ))") / 1e6).alias("time_s"),
        v.alias("dep_m"), (v * 0.9).alias("inst_dep_m"), (v * 7.3 % 360.0).alias("instr_heading"), (v / 25.0).alias("speed_ms"),
        ((i % 1000) * 0.001 + F.lit(-90.0)).alias("lon"), (v * 0.0001 + F.lit(30.0)).alias("lat"), ((i % 1000) * 1.5).alias("e"), (v * 2.0).alias("n"),
        (i % 50 + 100).cast("int").alias("ping_cnt"), F.lit(0.05).alias("pixM"), (i * 0.5).alias("trk_dist"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.expr("vec_id div 50").alias("chunk_id"), (F.col("label") + 2).alias("bed"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))


V = """WITH v AS (SELECT vec_id, vec_id // 50 AS chunk_id, label + 2 AS bed, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS r FROM embeddings)
"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 100).alias("gx"), (F.col("l_suppkey") % 100).alias("gy"), F.col("l_quantity").alias("v"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )


X = """WITH x AS (SELECT l_partkey % 100 AS gx, l_suppkey % 100 AS gy, l_quantity AS v, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
"""
REC = ("rec_id",)


def r(c: str, n: int = 4) -> F.Column:
    return F.round(c, n).alias(c)


# ---- filters


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    p = pings(spark, sf)
    log = p.where("beam IN ('error', 'signup')").select("rec_id", "record_num", "time_s", (F.col("beam") == "signup").alias("keep"))
    df = as_of(p, log, "time_s", "time_s", "keep", "state", REC, "record_num")
    df = filters.coordinate_outliers(df.withColumn("filter", F.coalesce("state", F.lit(False))), keys=REC).where("filter")
    df = df.withColumn("index", (F.col("record_num") / 200).cast("long"))
    df = df.withColumn("index", F.row_number().over(Window.partitionBy("rec_id").orderBy("record_num")) + F.col("index"))
    df = tracks.transects(df, 5, keys=REC)
    return df.groupBy("rec_id", "transect", "chunk_id").agg(F.count("*").alias("n"), F.round(F.avg("dep_m"), 4).alias("mean_depth"), F.round(F.percentile("dep_m", F.lit(0.5)), 4).alias("median_depth"))


ASOF = """, ev AS (SELECT rec_id, time_s, beam = 'signup' AS keep FROM p WHERE beam IN ('error', 'signup')),
 s AS (SELECT p.*, ev.keep FROM p ASOF LEFT JOIN ev ON p.rec_id = ev.rec_id AND p.time_s >= ev.time_s)
"""
_queries["survey_chunks"] = flagship
_sql["survey_chunks"] = P + ASOF + """, k AS (SELECT * FROM s WHERE coalesce(keep, false)),
 q AS (SELECT rec_id, quantile_cont(lon, 0.25) a, quantile_cont(lon, 0.75) b, quantile_cont(lat, 0.25) c, quantile_cont(lat, 0.75) d FROM p GROUP BY 1),
 f AS (SELECT k.*, row_number() OVER (PARTITION BY k.rec_id ORDER BY record_num) + record_num // 200 AS ix FROM k JOIN q USING (rec_id)
  WHERE NOT (lon < a - 3 * (b - a) OR lon > b + 3 * (b - a) OR lat < c - 3 * (d - c) OR lat > d + 3 * (d - c))),
 j AS (SELECT *, CASE WHEN ix - lag(ix) OVER (PARTITION BY rec_id ORDER BY ix) <> 1 THEN 1 ELSE 0 END AS jump FROM f),
 t AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY rec_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS INTEGER) AS transect FROM j),
 c AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, transect ORDER BY ix) - 1) // 5 AS pos FROM t),
 g AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY rec_id ORDER BY transect, pos) - 1 AS INTEGER) AS chunk_id FROM c)
SELECT rec_id, transect, chunk_id, count(*) AS n, round(avg(dep_m), 4) AS mean_depth, round(quantile_cont(dep_m, 0.5), 4) AS median_depth FROM g GROUP BY 1, 2, 3"""


@query(P + ASOF + "SELECT rec_id, record_num, coalesce(keep, false) AS filter_dq FROM s")
def dq_asof_keep(spark, sf):
    p = pings(spark, sf)
    log = p.where("beam IN ('error', 'signup')").select("rec_id", "record_num", "time_s", (F.col("beam") == "signup").alias("keep"))
    return as_of(p, log, "time_s", "time_s", "keep", "state", REC, "record_num").select("rec_id", "record_num", F.coalesce("state", F.lit(False)).alias("filter_dq"))


@query(P + """, q AS (SELECT rec_id, quantile_cont(lon, 0.25) a, quantile_cont(lon, 0.75) b, quantile_cont(lat, 0.25) c, quantile_cont(lat, 0.75) d FROM p GROUP BY 1)
SELECT rec_id, record_num, NOT (lon < a - 1.5 * (b - a) OR lon > b + 1.5 * (b - a) OR lat < c - 1.5 * (d - c) OR lat > d + 1.5 * (d - c)) AS filter FROM p JOIN q USING (rec_id)""")
def coord_iqr(spark, sf):
    return filters.coordinate_outliers(pings(spark, sf), 1.5, REC).select("rec_id", "record_num", "filter")


@query(P + "SELECT record_num, NOT (speed_ms < 0.5 OR speed_ms > 4) AS filter FROM p")
def speed_filter(spark, sf):
    return filters.speed(pings(spark, sf), 0.5, 4).select("record_num", "filter")


@query(P + """, iv AS (SELECT least(a, b) a, greatest(a, b) b FROM (SELECT min(o_orderkey) * 40.0e0 + 1000 AS a, min(o_orderkey) * 40.0e0 + 5000 + (o_custkey % 7) * 1000 AS b FROM orders GROUP BY o_custkey % 7, o_orderkey // 500)),
 m AS (SELECT min(time_s) AS z FROM p)
SELECT record_num, EXISTS (SELECT 1 FROM iv WHERE time_s BETWEEN a + z AND b + z) AS filter_time FROM p, m""")
def time_interval_semi(spark, sf):
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 7).alias("k"), F.expr("o_orderkey div 500").alias("h")).agg(F.min("o_orderkey").alias("m"))
    iv = o.select((F.col("m") * 40.0 + 1000).alias("end_seconds"), (F.col("m") * 40.0 + 5000 + F.col("k") * 1000).alias("start_seconds"))
    return filters.time_intervals(pings(spark, sf), iv, relative=True).select("record_num", "filter_time")


@query(P + """, m AS (SELECT *, max(trk_dist) OVER (PARTITION BY rec_id) AS far, count(instr_heading) OVER (PARTITION BY rec_id) AS k FROM p),
 b AS (SELECT *, CASE WHEN far <= 500 THEN 0 ELSE least(floor(trk_dist / 500), greatest(ceil(far / 500) - 1, 0)) END AS bin FROM m),
 d AS (SELECT *, instr_heading - lag(instr_heading) OVER (PARTITION BY rec_id, bin ORDER BY record_num) AS step FROM b),
 f AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < 180 THEN 0e0 ELSE (CASE WHEN (((step + 180) % 360e0) + 360e0) % 360e0 - 180 = -180 AND step > 0 THEN 180e0 ELSE (((step + 180) % 360e0) + 360e0) % 360e0 - 180 END) - step END AS fix FROM d),
 u AS (SELECT *, instr_heading + sum(fix) OVER (PARTITION BY rec_id, bin ORDER BY record_num ROWS UNBOUNDED PRECEDING) AS u FROM f),
 w AS (SELECT *, max(u) OVER (PARTITION BY rec_id, bin) - min(u) OVER (PARTITION BY rec_id, bin) AS span, count(u) OVER (PARTITION BY rec_id, bin) AS nb,
  trk_dist - lag(trk_dist) OVER o AS back, lead(trk_dist) OVER o - trk_dist AS ahead FROM u WINDOW o AS (PARTITION BY rec_id ORDER BY record_num))
SELECT record_num, (k < 2 OR (span < 400 AND nb > 1)) AND NOT coalesce(back > 500, false) AND NOT coalesce(ahead > 500, false) AS filter FROM w""")
def heading_window_dev(spark, sf):
    return filters.heading(pings(spark, sf), 400, 500, REC).select("record_num", "filter")


@query(P + """, j AS (SELECT *, CASE WHEN ix - lag(ix) OVER (PARTITION BY rec_id ORDER BY ix) <> 1 THEN 1 ELSE 0 END AS jump FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) + record_num // 1000 AS ix FROM p)),
 t AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY rec_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS INTEGER) AS transect FROM j),
 c AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, transect ORDER BY ix) - 1) // 4 AS pos FROM t)
SELECT rec_id, record_num, transect, CAST(dense_rank() OVER (PARTITION BY rec_id ORDER BY transect, pos) - 1 AS INTEGER) AS chunk_id FROM c""")
def transect_chunk(spark, sf):
    return tracks.transects(_gaps(pings(spark, sf)), 4, keys=REC).select("rec_id", "record_num", "transect", "chunk_id")


def _gaps(p: DataFrame) -> DataFrame:
    return p.withColumn("index", F.row_number().over(Window.partitionBy("rec_id").orderBy("record_num")) + F.expr("record_num div 1000"))


@query(P + """, j AS (SELECT *, CASE WHEN ix - lag(ix) OVER (PARTITION BY rec_id ORDER BY ix) <> 1 THEN 1 ELSE 0 END AS jump FROM (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) + record_num // 1000 AS ix FROM p)),
 t AS (SELECT *, sum(jump) OVER (PARTITION BY rec_id ORDER BY ix ROWS UNBOUNDED PRECEDING) AS run FROM j)
SELECT rec_id, record_num, count(*) OVER (PARTITION BY rec_id, run) >= 7 AS filter FROM t""")
def short_transect_drop(spark, sf):
    return filters.short_transects(_gaps(pings(spark, sf)), 7, keys=REC).select("rec_id", "record_num", "filter")


@query(P + """, c AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS cnt FROM p)
SELECT rec_id, record_num, CAST(least(i // 10, greatest((cnt - 1) // 10 - CASE WHEN cnt % 10 > 0 AND cnt % 10 <= 5 THEN 1 ELSE 0 END, 0)) AS INTEGER) AS chunk_id FROM c""")
def chunk_tail_merge(spark, sf):
    return tracks.chunks(pings(spark, sf), 10, REC).select("rec_id", "record_num", "chunk_id")


@query(P + """, a AS (SELECT *, record_num // 100 AS chunk_id, record_num % 7 > 0 AS ok FROM p), b AS (SELECT *, ok AND dep_m > 20 AS good FROM a),
 c AS (SELECT *, CASE WHEN bool_or(good) OVER (PARTITION BY rec_id, chunk_id) THEN good ELSE ok END AS keep FROM b)
SELECT rec_id, record_num FROM (SELECT *, bool_or(keep) OVER (PARTITION BY rec_id, chunk_id) AS any_kept FROM c) WHERE keep OR NOT any_kept""")
def sane_chunk_rows(spark, sf):
    p = pings(spark, sf).withColumns({"chunk_id": F.expr("record_num div 100"), "ping_cnt": (F.col("record_num") % 7).cast("int"), "pixM": F.when(F.col("dep_m") > 20, 0.05).otherwise(0.0)})
    return filters.sane_chunk(p, ("rec_id", "chunk_id")).select("rec_id", "record_num")


@query("""WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events)
SELECT event_id, CASE WHEN k < 30 THEN 'low' WHEN k < 70 THEN 'mid' ELSE 'high' END AS band, k * 2 AS twice FROM k""")
def json_fields(spark, sf):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select("event_id", F.when(k < 30, "low").when(k < 70, "mid").otherwise("high").alias("band"), (k * 2).alias("twice"))


@query(P + "SELECT record_num, (e - 750e0) * (e - 750e0) < 250000e0 AND e > 300 AND e < 1200 AND n > 20 AND n < 150 AS filter FROM p")
def area_of_interest(spark, sf):
    p = filters.area(pings(spark, sf), [[(300, 20), (1200, 20), (1200, 150), (300, 150)]])
    return p.select("record_num", (F.col("filter") & ((F.col("e") - 750) * (F.col("e") - 750) < 250000)).alias("filter"))


# ---- tracks and depth


@query(P + "SELECT rec_id, record_num, round(quantile_cont(dep_m, 0.5) OVER (PARTITION BY rec_id ORDER BY record_num ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING), 4) AS med FROM p")
def rolling_median_31(spark, sf):
    w = Window.partitionBy("rec_id").orderBy("record_num")
    return pings(spark, sf).select("rec_id", "record_num", F.round(rolling_median(F.col("dep_m"), w), 4).alias("med"))


@query(P + """, a AS (SELECT *, quantile_cont(dep_m, 0.5) OVER (PARTITION BY rec_id ORDER BY record_num ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS med FROM p),
 b AS (SELECT *, quantile_cont(dep_m - med, 0.5) OVER (PARTITION BY rec_id) AS mid FROM a), c AS (SELECT *, quantile_cont(abs(dep_m - med - mid), 0.5) OVER (PARTITION BY rec_id) AS mad,
  dep_m - lag(dep_m) OVER w AS d0, dep_m - lead(dep_m) OVER w AS d1 FROM b WINDOW w AS (PARTITION BY rec_id ORDER BY record_num))
SELECT rec_id, record_num, coalesce(abs(dep_m - med) > greatest(0.5, 6 * mad), false) OR coalesce(abs(d0) > 60 AND abs(d1) > 60 AND sign(d0) = sign(d1), false)
 OR coalesce(inst_dep_m > 0 AND dep_m > 3 * inst_dep_m, false) AS depth_bad FROM c""")
def mad_flags(spark, sf):
    return depth.outliers(pings(spark, sf), keys=REC, jump_m=60).select("rec_id", "record_num", "depth_bad")


@query(P + """, v AS (SELECT *, CASE WHEN dep_m > 30 THEN dep_m END AS x, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) AS i FROM p),
 f AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS p0, last_value(x IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p1 FROM v
  WINDOW a AS (PARTITION BY rec_id ORDER BY record_num ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rec_id ORDER BY record_num DESC ROWS UNBOUNDED PRECEDING))
SELECT rec_id, record_num, round(CASE WHEN x IS NOT NULL THEN x WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i - p0) / (p1 - p0) END, 7) AS filled FROM f""")
def depth_lerp(spark, sf):
    return fill_linear(pings(spark, sf), "dep_m", REC, "record_num", "filled", F.col("dep_m") > 30).select("rec_id", "record_num", r("filled", 7))


@query(P + """, s AS (SELECT rec_id, record_num // 10 AS rn, max(CASE WHEN beam = 'view' THEN dep_m END) AS port, max(CASE WHEN beam = 'click' THEN dep_m END) AS star FROM p GROUP BY 1, 2),
 a AS (SELECT *, coalesce(abs(port - star) > 25, false) AS apart FROM s)
SELECT rec_id, rn AS record_num, apart, round(CASE WHEN apart THEN NULL WHEN port IS NULL THEN star WHEN star IS NULL THEN port ELSE (port + star) / 2 END, 4) AS dep_mean FROM a""")
def cross_beam_divergence(spark, sf):
    beam = F.when(F.col("beam") == "view", "ss_port").when(F.col("beam") == "click", "ss_star").otherwise(F.col("beam"))
    p = pings(spark, sf).withColumns({"beam": beam, "record_num": F.expr("record_num div 10")})
    return depth.sides_agree(p, 25).select("rec_id", "record_num", "apart", r("dep_mean"))


@query(P + """, d AS (SELECT *, instr_heading - lag(instr_heading) OVER (PARTITION BY rec_id ORDER BY record_num) AS step FROM p),
 f AS (SELECT *, CASE WHEN step IS NULL OR abs(step) < 180 THEN 0e0 ELSE (((step + 180) % 360e0) + 360e0) % 360e0 - 180 - step END AS fix FROM d)
SELECT rec_id, record_num, round(instr_heading + sum(fix) OVER (PARTITION BY rec_id ORDER BY record_num ROWS UNBOUNDED PRECEDING), 3) AS heading_u FROM f""")
def heading_unwrap(spark, sf):
    w = Window.partitionBy("rec_id").orderBy("record_num")
    return unwrap(pings(spark, sf), "instr_heading", w, "heading_u").select("rec_id", "record_num", r("heading_u", 3))


@query(P + """, n AS (SELECT *, lead(lon) OVER w AS x1, lead(lat) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY rec_id ORDER BY record_num)),
 b AS (SELECT *, (degrees(atan2(sin(radians(x1 - lon)) * cos(radians(y1)), cos(radians(lat)) * sin(radians(y1)) - sin(radians(lat)) * cos(radians(y1)) * cos(radians(x1 - lon)))) + 360) % 360 AS b FROM n)
SELECT rec_id, record_num, round(coalesce(b, lag(b) OVER (PARTITION BY rec_id ORDER BY record_num)), 4) AS cog FROM b""")
def bearing_lead(spark, sf):
    return tracks.bearings(pings(spark, sf), REC).select("rec_id", "record_num", r("cog"))


@query(P + """, d AS (SELECT *, dep_m / 6378137e0 AS d, radians(instr_heading) AS t, radians(lat) AS a FROM p), b AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(t)) AS b FROM d)
SELECT record_num, round(degrees(radians(lon) + atan2(sin(t) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))), 8) AS x, round(degrees(b), 8) AS y FROM b""")
def destination_point(spark, sf):
    x, y = geo.destination(F.col("lon"), F.col("lat"), F.col("instr_heading"), F.col("dep_m"))
    return pings(spark, sf).select("record_num", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"))


@query(P + "SELECT record_num, '326' || lpad(CAST(CAST(floor((lon + 180) / 6) AS INTEGER) % 60 + 1 AS VARCHAR), 2, '0') AS epsg FROM p")
def utm_zone(spark, sf):
    return pings(spark, sf).select("record_num", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query(P + """, m AS (SELECT rec_id, record_num // 100 AS chunk_id, ping_cnt, count(*) AS k FROM p GROUP BY 1, 2, 3), o AS (SELECT rec_id, chunk_id, ping_cnt, row_number() OVER (PARTITION BY rec_id, chunk_id ORDER BY k DESC, ping_cnt) AS i FROM m)
SELECT rec_id, chunk_id, round(ping_cnt * 0.05e0, 4) AS range_m FROM o WHERE i = 1""")
def range_mode(spark, sf):
    p = pings(spark, sf).withColumn("chunk_id", F.expr("record_num div 100"))
    return p.groupBy("rec_id", "chunk_id").agg(F.round(F.mode("ping_cnt", True) * F.mode("pixM", True), 4).alias("range_m"))


@query(P + """, c AS (SELECT *, record_num // 100 AS chunk_id FROM p), w AS (SELECT *, lag(chunk_id) OVER o AS before, lag(dep_m, 2) OVER o AS second FROM c WINDOW o AS (PARTITION BY rec_id ORDER BY record_num))
SELECT rec_id, record_num, CASE WHEN chunk_id <> before AND second IS NOT NULL THEN second ELSE dep_m END AS dep_m FROM w""")
def seam_patch(spark, sf):
    p = pings(spark, sf).withColumn("chunk_id", F.expr("record_num div 100"))
    return tracks.patch_seams(p, ("dep_m",), REC).select("rec_id", "record_num", "dep_m")


@query(P + """, c AS (SELECT rec_id, beam, record_num // 1000 AS cycle, max(record_num) AS record_num FROM p GROUP BY 1, 2, 3), k AS (SELECT DISTINCT rec_id, cycle FROM c)
SELECT k.rec_id, k.cycle, b.beam, c.record_num FROM k CROSS JOIN (VALUES ('click'), ('view'), ('purchase')) b(beam) LEFT JOIN c ON c.rec_id = k.rec_id AND c.cycle = k.cycle AND c.beam = b.beam""")
def missing_ping_cross_join(spark, sf):
    p = pings(spark, sf).groupBy("rec_id", "beam", F.expr("record_num div 1000").alias("cycle")).agg(F.max("record_num").alias("record_num"))
    return tracks.completed(p, ["click", "view", "purchase"]).select("rec_id", "cycle", "beam", "record_num")


@query(P + "SELECT 'dep_m' AS \"column\", min(dep_m) AS least, max(dep_m) AS most, round(avg(dep_m), 4) AS mean, max(dep_m) > 0 AS valid FROM p UNION ALL SELECT 'speed_ms', min(speed_ms), max(speed_ms), round(avg(speed_ms), 4), max(speed_ms) > 0 FROM p")
def ping_profile(spark, sf):
    return tracks.profile(pings(spark, sf), ["dep_m", "speed_ms"]).withColumn("mean", F.round("mean", 4))


@query(P + """, n AS (SELECT rec_id, beam, count(*) AS k FROM p GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY k DESC, beam) AS i FROM n) SELECT rec_id, beam FROM o WHERE i = 1""")
def longest_beam(spark, sf):
    return tracks.longest_beam(pings(spark, sf))


@query(P + "SELECT rec_id, record_num // 100 AS chunk_id FROM p WHERE beam = 'view' INTERSECT SELECT rec_id, record_num // 100 FROM p WHERE beam = 'click'")
def chunk_id_intersect(spark, sf):
    p = pings(spark, sf).withColumn("chunk_id", F.expr("record_num div 100"))
    return p.where("beam = 'view'").select("rec_id", "chunk_id").intersect(p.where("beam = 'click'").select("rec_id", "chunk_id"))


@query(P + "SELECT rec_id, beam, arg_max(dep_m, record_num) AS dep_m, max(record_num) AS record_num FROM p GROUP BY 1, 2")
def latest_by_key(spark, sf):
    return pings(spark, sf).groupBy("rec_id", "beam").agg(F.max_by("dep_m", "record_num").alias("dep_m"), F.max("record_num").alias("record_num"))


@query(P + """, ev AS (SELECT rec_id, time_s + 30 AS at, beam = 'signup' AS keep FROM p WHERE beam IN ('error', 'signup'))
SELECT p.rec_id, p.record_num, coalesce(ev.keep, false) AS filter_dq FROM p ASOF LEFT JOIN ev ON p.rec_id = ev.rec_id AND p.time_s >= ev.at""")
def quality_state_keep(spark, sf):
    """The quality-log filter itself: flags as text, numeric times, a shift of 30 seconds."""
    p = pings(spark, sf)
    log = p.where("beam IN ('error', 'signup')").select("rec_id", F.col("time_s").alias("at"), F.concat(F.lit(" "), F.upper("beam")).alias("state"), F.col("record_num").alias("file_row"))
    return filters.quality_state(p, log, "at", "state", "Signup, ok", shift_seconds=30, by=REC).select("rec_id", "record_num", "filter_dq")


L = P + """, l AS (SELECT rec_id, beam, record_num, record_num // 2000 AS chunk_id, e, n, e + (dep_m * 7.3e0) % 40e0 - 20e0 AS range_e, n + (dep_m * 3.1e0) % 40e0 - 20e0 AS range_n, 30e0 AS range_m, dep_m FROM p)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    at = {"chunk_id": F.expr("record_num div 2000"), "range_e": F.col("e") + F.col("dep_m") * 7.3 % 40.0 - 20.0, "range_n": F.col("n") + F.col("dep_m") * 3.1 % 40.0 - 20.0, "range_m": F.lit(30.0)}
    return pings(spark, sf).withColumns(at)


@query(L + """, d AS (SELECT a.rec_id, b.record_num, (a.range_e - a.e) * (b.range_n - b.n) - (a.range_n - a.n) * (b.range_e - b.e) AS den, (b.e - a.e) * (b.range_n - b.n) - (b.n - a.n) * (b.range_e - b.e) AS t,
  (b.e - a.e) * (a.range_n - a.n) - (b.n - a.n) * (a.range_e - a.e) AS u FROM l a JOIN l b ON a.rec_id = b.rec_id AND a.chunk_id = b.chunk_id AND a.record_num < b.record_num
  WHERE sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) <= 60),
 h AS (SELECT DISTINCT rec_id, record_num FROM d WHERE den <> 0 AND t / den BETWEEN 0 AND 1 AND u / den BETWEEN 0 AND 1)
SELECT l.rec_id, l.record_num, h.record_num IS NOT NULL AS overlap FROM l LEFT JOIN h ON l.rec_id = h.rec_id AND l.record_num = h.record_num""")
def overlap_flags(spark, sf):
    return tracks.overlaps(lines(spark, sf), ("rec_id", "chunk_id")).select("rec_id", "record_num", "overlap")


@query(L + """, i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY rec_id, chunk_id) AS k FROM l WINDOW w AS (PARTITION BY rec_id, chunk_id ORDER BY record_num)),
 v AS (SELECT *, CASE WHEN i % 5 = 0 OR i = k - 1 THEN range_e END AS x FROM i),
 f AS (SELECT *, last_value(x IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS p0, last_value(x IGNORE NULLS) OVER b AS v1, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS p1 FROM v
  WINDOW a AS (PARTITION BY rec_id, chunk_id ORDER BY record_num ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY rec_id, chunk_id ORDER BY record_num DESC ROWS UNBOUNDED PRECEDING))
SELECT rec_id, record_num, round(CASE WHEN x IS NOT NULL THEN x ELSE v0 + (v1 - v0) * (i - p0) / (p1 - p0) END, 6) AS range_e FROM f""")
def relinearised_edges(spark, sf):
    return tracks.relinearise(lines(spark, sf), 5, ("rec_id", "chunk_id"), ("range_e",)).select("rec_id", "record_num", r("range_e", 6))


@query("""WITH o AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier)
SELECT CAST(item AS INTEGER) AS item, CAST(pos AS INTEGER) AS pos, k + pos * 0.25e0 AS x, CAST(n AS DOUBLE) AS y FROM o CROSS JOIN (VALUES (0, 0), (0, 1), (0, 2), (2, 0)) v(item, pos)""")
def json_plan_explode(spark, sf):
    """A mission plan as JSON per supplier: a ring of three corners, an item without one, a ring of one."""
    corner = lambda i: F.array(F.col("s_nationkey").cast("double"), F.col("s_suppkey") + i * 0.25)
    item = lambda *c: F.struct(F.array(*map(corner, c)).alias("polygon"))
    none = F.struct(F.lit(None).cast("array<array<double>>").alias("polygon"))
    plans = table(spark, sf, "supplier").select(F.to_json(F.struct(F.struct(F.array(item(0, 1, 2), none, item(0)).alias("items")).alias("mission"))).alias("value"))
    return filters.plan_rings(plans).select("item", F.posexplode("ring").alias("pos", "p")).select("item", "pos", "p.x", "p.y")


# ---- samples


@query(V + "SELECT vec_id, round(sum(CASE WHEN r >= bed THEN x ELSE 0 END), 4) AS below, round(sum(CASE WHEN r < bed THEN x ELSE 0 END), 4) AS above FROM v GROUP BY 1")
def mask_water_column(spark, sf):
    add = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 4)
    s = F.col("samples")
    return vectors(spark, sf).select("vec_id", add(samples.keep_bed(s, F.col("bed"))).alias("below"), add(samples.keep_water(s, F.col("bed"), F.col("bed"))).alias("above"))


@query(V + """, g AS (SELECT vec_id, CAST(round_even(sqrt(CAST(r * r - bed * bed AS DOUBLE)), 0) AS INTEGER) AS i, arg_max(x, r) AS v FROM v WHERE r >= bed GROUP BY 1, 2)
SELECT vec_id, i, round(v, 4) + 0e0 AS v FROM g""")
def slant_range_regroup(spark, sf):
    return samples.slant_range(vectors(spark, sf), ("vec_id",)).where("v IS NOT NULL").select("vec_id", "i", (F.round("v", 4) + 0.0).alias("v"))


@query(V + """, q AS (SELECT chunk_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.995) AS hi FROM v WHERE x > 0 GROUP BY 1)
SELECT vec_id, CAST(r AS INTEGER) AS r, CAST(trunc(greatest(least(round((x - lo) / (hi - lo) * 255, 6), 255), 0)) AS INTEGER) AS b FROM v JOIN q USING (chunk_id)""")
def uint8_percentile_scale(spark, sf):
    v = vectors(spark, sf).select("vec_id", "chunk_id", F.posexplode("samples").alias("r", "x"))
    q = samples.stretch_bounds(v, "x", ("chunk_id",))
    return v.join(q, "chunk_id").select("vec_id", "r", F.greatest(F.least(F.round((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, 6), F.lit(255.0)), F.lit(0.0)).cast("int").alias("b"))


@query(V + "SELECT vec_id, CAST(r AS INTEGER) AS r, round(x * pow(10e0, least(greatest(20 * log10((r + 1) * 0.05e0) + 0.02e0 * ((r + 1) * 0.05e0), 0), 60) / 20), 4) AS v FROM v")
def time_varying_gain(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(samples.tvg(F.col("samples"), 20.0, 0.01, 60.0, 0.05)).alias("r", "v")).select("vec_id", "r", r("v"))


@query(V + """, m AS (SELECT *, min(CASE WHEN abs(x) > 0 THEN abs(x) END) OVER (PARTITION BY chunk_id) AS least FROM v)
SELECT vec_id, CAST(r AS INTEGER) AS r, round(20 * log10(greatest(abs(x), least)) - 20 * log10(least), 3) AS db FROM m""")
def display_decibels(spark, sf):
    v = vectors(spark, sf).select("vec_id", "chunk_id", F.posexplode("samples").alias("r", "x"))
    return v.select("vec_id", "r", F.round(samples.decibels(F.abs("x"), Window.partitionBy("chunk_id")), 3).alias("db"))


@query(X + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v, CAST(round_even(least(floor(v / 50 * 254), 254) / 254 * 255, 0) AS INTEGER) AS g FROM x WHERE v <= 50""")
def colormap_join(spark, sf):
    x = pixels(spark, sf).where("v <= 50")
    return samples.colorize(x, F.col("v") / 50, samples.level_colors(spark)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v", "g")


@query(X + "SELECT gx, gy, l_orderkey, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 9 + 1, 4) AS z FROM x WINDOW w AS (PARTITION BY gy)")
def min_max_rescale(spark, sf):
    return samples.rescale(pixels(spark, sf), "v", 1.0, 10.0, ("gy",), "z").select("gx", "gy", "l_orderkey", r("z"))


@query(V + """, m AS (SELECT chunk_id, quantile_cont(x, 0.5) AS m FROM v WHERE x > 0 GROUP BY 1)
SELECT vec_id, CAST(r AS INTEGER) AS r, round(x * coalesce(least(greatest(0.09e0 / m, 0.75e0), 1.25e0), 1), 6) AS y FROM v LEFT JOIN m USING (chunk_id)""")
def median_match(spark, sf):
    v = vectors(spark, sf).select("vec_id", "chunk_id", F.posexplode("samples").alias("r", "x"))
    return samples.match_median(v, "x", ("chunk_id",), 0.09, "y").select("vec_id", "r", r("y", 6))


@query(V + """, c AS (SELECT vec_id, r, vec_id * 100e0 + r AS x FROM v WHERE r < 50 + vec_id % 20) SELECT c.vec_id, CAST(c.r AS INTEGER) AS row, c.x, v.x AS v FROM c JOIN v ON c.vec_id = v.vec_id AND c.r = v.r""")
def ping_explode_join(spark, sf):
    """Samples exploded and joined to coordinates that reach less far, by record and row."""
    v = vectors(spark, sf)
    coords = v.select("vec_id", F.explode(F.sequence(F.lit(0), (F.least(F.col("vec_id") % 20 + 50, F.size("samples").cast("long")) - 1).cast("int"))).alias("row"))
    return mosaic.attach(coords.withColumn("x", F.col("vec_id") * 100.0 + F.col("row")), v, ("vec_id",)).select("vec_id", "row", "x", "v")


# ---- gain normalisation

E_SQL = X + """, c AS (SELECT l_suppkey % 3 AS rec_id, l_linenumber AS beam, l_orderkey // 5000 AS chunk_id, l_partkey % 64 AS row, v, l_orderkey, l_partkey, l_suppkey FROM x),
 k AS (SELECT c.* FROM c JOIN (SELECT rec_id, beam, max(chunk_id) AS z FROM c GROUP BY 1, 2) USING (rec_id, beam) WHERE chunk_id < z),
 m AS (SELECT rec_id, beam, chunk_id, row, avg(nullif(v, 0)) AS cm FROM k GROUP BY 1, 2, 3, 4), g AS (SELECT rec_id, beam, row, avg(cm) AS row_mean, max(row) OVER (PARTITION BY rec_id, beam) AS last FROM m GROUP BY 1, 2, 3),
 f AS (SELECT c.*, v / row_mean AS egn FROM c LEFT JOIN (SELECT rec_id, beam, max(last) AS last FROM g GROUP BY 1, 2) l USING (rec_id, beam) LEFT JOIN g ON c.rec_id = g.rec_id AND c.beam = g.beam AND least(c.row, l.last) = g.row)
"""


def _gain_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select(
        (F.col("l_suppkey") % 3).alias("rec_id"), F.col("l_linenumber").alias("beam"), F.expr("l_orderkey div 5000").alias("chunk_id"), (F.col("l_partkey") % 64).alias("row"), "v", "l_orderkey", "l_partkey", "l_suppkey"
    )


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return egn.global_means(egn.chunk_means(egn.without_last_chunk(_gain_pixels(spark, sf))))


@query(E_SQL + "SELECT rec_id, beam, row, round(row_mean, 6) AS row_mean FROM g")
def egn_means(spark, sf):
    return _means(spark, sf).select("rec_id", "beam", "row", r("row_mean", 6))


@query(E_SQL + "SELECT rec_id, beam, chunk_id, round(min(egn), 6) AS lo, round(max(egn), 6) AS hi FROM f GROUP BY 1, 2, 3")
def egn_minmax(spark, sf):
    return egn.min_max(egn.correct(_gain_pixels(spark, sf), _means(spark, sf))).select("rec_id", "beam", "chunk_id", r("lo", 6), r("hi", 6))


@query(E_SQL + """, e AS (SELECT rec_id, min(egn) AS lo, max(egn) AS hi FROM f GROUP BY 1)
SELECT rec_id, beam, chunk_id, l_orderkey, l_partkey, l_suppkey, round(egn, 6) AS egn, round(coalesce(least(greatest((egn - lo) / nullif(hi - lo, 0) * 255, 0), 255), 0), 4) AS out FROM f JOIN e USING (rec_id)""")
def egn_correct(spark, sf):
    """The whole correction: each recording by its own means and extremes."""
    fixed = egn.correct(_gain_pixels(spark, sf), _means(spark, sf))
    scaled = egn.with_extremes(fixed, egn.fold_min_max(egn.min_max(fixed)))
    return scaled.select("rec_id", "beam", "chunk_id", "l_orderkey", "l_partkey", "l_suppkey", r("egn", 6), F.round(egn.rescale(F.col("egn"), F.col("lo"), F.col("hi")), 4).alias("out"))


@query(X + "SELECT l_linenumber AS beam, CAST(least(floor(v * 5), 254) AS INTEGER) AS bin, count(*) AS n FROM x WHERE v * 5 BETWEEN 0 AND 255 GROUP BY 1, 2")
def egn_hist(spark, sf):
    return egn.histogram(pixels(spark, sf).select(F.col("l_linenumber").alias("beam"), (F.col("v") * 5).alias("v")), ("beam",))


@query(X + """, h AS (SELECT CAST(least(floor(v * 5), 254) AS INTEGER) AS bin, count(*) AS n FROM x GROUP BY 1), s AS (SELECT bin, n / sum(n) OVER () AS s FROM h WHERE bin > 0),
 t AS (SELECT bin, sum(s) OVER (ORDER BY bin) AS a, sum(s) OVER (ORDER BY bin DESC) AS b FROM s)
SELECT coalesce(max(CASE WHEN a < 0.07 THEN bin END), min(bin)) AS lo, coalesce(min(CASE WHEN b < 0.07 THEN bin END), max(bin)) AS hi FROM t""")
def egn_stretch_clip(spark, sf):
    return egn.stretch_percent(egn.histogram(pixels(spark, sf).select(F.col("l_linenumber").alias("beam"), (F.col("v") * 5).alias("v")), ("beam",)), 7)


@query(X + """SELECT gx, gy, l_orderkey, l_linenumber, round(255 * least(greatest(pow((CASE WHEN v = 0 THEN 0 ELSE (least(greatest(v, 5), 45) - 5) / 40e0 * 255 END) / 255, 0.8e0) * 1.1e0, 0), 1), 4) AS t FROM x""")
def egn_tone(spark, sf):
    v = egn.tone(egn.stretch(F.col("v"), F.lit(5.0), F.lit(45.0)), 0.8, 1.1)
    return pixels(spark, sf).select("gx", "gy", "l_orderkey", "l_linenumber", F.round(v, 4).alias("t"))


@query(P + """, c AS (SELECT rec_id, beam, record_num // 100 AS chunk_id, quantile_cont(ping_cnt * pixM, 0.5) AS m FROM p GROUP BY 1, 2, 3) SELECT rec_id, beam, round(quantile_cont(m, 0.5), 6) AS ref_m FROM c GROUP BY 1, 2""")
def range_reference(spark, sf):
    p = pings(spark, sf).withColumn("chunk_id", F.expr("record_num div 100"))
    return egn.range_reference(egn.chunk_range(p)).select("rec_id", "beam", r("ref_m", 6))


# ---- mosaics


@query(X + "SELECT gx, gy, round(avg(v), 6) AS v, count(*) AS n FROM x GROUP BY 1, 2")
def raster_mean(spark, sf):
    return mosaic.raster_mean(pixels(spark, sf)).select("gx", "gy", r("v", 6), "n")


TILE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "v")
for _how, _agg in (("first", "arg_min(v, o)"), ("last", "arg_max(v, o)"), ("max", "max(v)"), ("average", "round(avg(v), 6)"), ("sum", "sum(v)")):

    def _mosaic(spark, sf, how=_how):
        x = pixels(spark, sf).withColumn("v", F.col("v") - 1)
        return mosaic.merge(x, how, F.struct(*TILE_ORDER), limits=None).select("gx", "gy", r("v", 6))

    _queries[f"mosaic_{_how}"] = _mosaic
    _sql[f"mosaic_{_how}"] = X + f", y AS (SELECT gx, gy, v - 1 AS v, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, v) AS o FROM x WHERE v <> 1) SELECT gx, gy, {_agg} AS v FROM y GROUP BY 1, 2"


@query(X + ", s AS (SELECT gx, gy, l_linenumber AS layer, sum(v) AS v FROM x GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY v DESC, layer) AS i FROM s) SELECT gx, gy, layer AS cls FROM o WHERE i = 1")
def mosaic_classify(spark, sf):
    s = pixels(spark, sf).groupBy("gx", "gy", F.col("l_linenumber").alias("layer")).agg(F.sum("v").alias("v"))
    return mosaic.merge_class(s)


@query(X + ", m AS (SELECT gx, gy, avg(v) AS v FROM x GROUP BY 1, 2) SELECT gx >> 2 AS gx, gy >> 2 AS gy, round(avg(v), 9) AS v FROM m GROUP BY 1, 2")
def raster_pyramid(spark, sf):
    return mosaic.pyramid(mosaic.raster_mean(pixels(spark, sf)), 2).select("gx", "gy", r("v", 9))


@query(X + ", l AS (SELECT DISTINCT gx, gy, l_linenumber % 3 AS cls, l_linenumber % 3 AS priority FROM x) SELECT gx, gy, max(cls) AS cls FROM l GROUP BY 1, 2")
def priority_overlay(spark, sf):
    p = (F.col("l_linenumber") % 3).alias("cls")
    return mosaic.overlay(pixels(spark, sf).select("gx", "gy", p, (F.col("l_linenumber") % 3).alias("priority")))


@query(X + """, f AS (SELECT DISTINCT gx, gy FROM x WHERE v > 49), n AS (SELECT gx, gy, gx + dx AS nx, gy + dy AS ny FROM f CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy))
SELECT DISTINCT n.gx, n.gy FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.gx = n.nx AND f.gy = n.ny)""")
def mosaic_boundary(spark, sf):
    return mosaic.boundary(pixels(spark, sf).where("v > 49"))


@query(X + "SELECT CAST(floor((gx + 0.5) * 0.25 / 1.0) AS BIGINT) AS cx, count(*) AS n, sum(v) AS s FROM x GROUP BY 1")
def pixel_cells(spark, sf):
    x = mosaic.to_cells(pixels(spark, sf).select(((F.col("gx") + 0.5) * 0.25).alias("x"), F.col("gy").cast("double").alias("y"), "v"), 1.0)
    return x.groupBy(F.col("gx").alias("cx")).agg(F.count("*").alias("n"), F.sum("v").alias("s"))


# ---- substrate

L_SQL = """WITH l AS (SELECT vec_id, CAST(embedding[1:7] AS DOUBLE[]) AS z FROM embeddings), e AS (SELECT vec_id, unnest(z) AS z, generate_subscripts(z, 1) AS k FROM l),
 m AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM e), s AS (SELECT vec_id, k, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM m)
"""


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 7), lambda x: x.cast("double")).alias("logits"))


@query(L_SQL + ", o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, k) AS i FROM s) SELECT vec_id, CAST(k AS INTEGER) AS cls FROM o WHERE i = 1")
def class_argmax(spark, sf):
    return substrate.classify(logits(spark, sf)).select("vec_id", "cls")


@query(L_SQL + """, o AS (SELECT vec_id, arg_max(k, p) AS base, max(CASE WHEN k = 4 THEN p END) AS p4, max(CASE WHEN k = 3 THEN p END) AS p3 FROM s GROUP BY 1)
SELECT vec_id, CAST(CASE WHEN p4 >= 0.35 THEN 4 WHEN p3 >= 0.14 AND base = 4 THEN 3 ELSE base END AS INTEGER) AS cls FROM o""")
def class_threshold(spark, sf):
    return substrate.classify(logits(spark, sf), "thresh").select("vec_id", "cls")


@query(L_SQL + "SELECT vec_id, CAST(k AS INTEGER) AS k, CAST(round_even(p * 10000, 0) AS INTEGER) AS p FROM s")
def softmax_scaled(spark, sf):
    p = substrate.scaled(substrate.softmax(F.col("logits")))
    return logits(spark, sf).select("vec_id", F.posexplode(p).alias("k", "p")).select("vec_id", (F.col("k") + 1).alias("k"), "p")


@query("""WITH l AS (SELECT vec_id, unnest(CAST(embedding[1:7] AS DOUBLE[])) AS a, unnest(CAST(embedding[8:14] AS DOUBLE[])) AS b, generate_subscripts(embedding[1:7], 1) AS k FROM embeddings),
 m AS (SELECT vec_id, k, exp(a - max(a) OVER w) AS a, exp(b - max(b) OVER w) AS b FROM l WINDOW w AS (PARTITION BY vec_id)), s AS (SELECT vec_id, k, a / sum(a) OVER w AS a, b / sum(b) OVER w AS b FROM m WINDOW w AS (PARTITION BY vec_id)),
 o AS (SELECT vec_id, arg_max(k, b) AS cb, arg_max(k, a + b) AS cm FROM s GROUP BY 1) SELECT vec_id, CAST(CASE WHEN cb IN (2, 5, 6) THEN cb ELSE cm END AS INTEGER) AS cls FROM o""")
def model_average(spark, sf):
    e = table(spark, sf, "embeddings")
    part = lambda a: e.select("vec_id", F.transform(F.slice("embedding", a, 7), lambda x: x.cast("double")).alias("logits"))
    return substrate.average_models(part(1), part(8), ("vec_id",)).select("vec_id", "cls")


@query("""WITH a AS (SELECT p_brand AS river, l_linenumber AS cls, sum(l_quantity) AS area FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT river, sum(area) AS total,
 coalesce(sum(CASE WHEN cls IN (1, 2) THEN area END), 0) AS soft, coalesce(sum(CASE WHEN cls IN (3, 4) THEN area END), 0) AS hard, coalesce(sum(CASE WHEN cls IN (5, 6) THEN area END), 0) AS other FROM a GROUP BY 1)
SELECT river, total, soft, hard, other, round(soft / total, 6) AS soft_share, round(hard / total, 6) AS hard_share, round(other / total, 6) AS other_share FROM t""")
def class_area_share(spark, sf):
    a = _areas(spark, sf).groupBy("river", F.col("l_linenumber").alias("cls")).agg(F.sum("area").alias("area"))
    return substrate.area_shares(a, ("river",)).select("river", "total", "soft", "hard", "other", r("soft_share", 6), r("hard_share", 6), r("other_share", 6))


@query(V + """, m AS (SELECT *, r - row_number() OVER (PARTITION BY vec_id ORDER BY r) AS g FROM v WHERE x < -0.1) SELECT vec_id, count(*) AS spans, CAST(max(n) AS INTEGER) AS longest FROM (SELECT vec_id, g, max(r) - min(r) + 1 AS n FROM m GROUP BY 1, 2) GROUP BY 1""")
def shadow_spans(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode("samples").alias("row", "x")).withColumn("mask", F.col("x") < -0.1)
    s = substrate.shadow_spans(v, ("vec_id",))
    return s.select("vec_id", F.size("spans").cast("long").alias("spans"), F.array_max(F.transform("spans", lambda t: t["b"] - t["a"])).alias("longest"))


@query(V + """, z AS (SELECT vec_id, r, CASE WHEN x > 0.05 THEN 2 WHEN x < -0.05 THEN 1 ELSE 0 END AS c FROM v)
SELECT vec_id, CAST(r AS INTEGER) AS row, coalesce(last_value(nullif(c, 0) IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY r ROWS UNBOUNDED PRECEDING), last_value(nullif(c, 0) IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 0) AS cls FROM z""")
def zero_run_fill(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.posexplode("samples").alias("row", "x")).withColumn("cls", F.when(F.col("x") > 0.05, 2).when(F.col("x") < -0.05, 1).otherwise(0))
    return substrate.fill_zero_runs(v, ("vec_id",)).select("vec_id", "row", "cls")


# ---- reaches


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    li, pa = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(pa, li["l_partkey"] == pa["p_partkey"]).select(F.col("p_brand").alias("river"), F.col("p_type").alias("basin"), "l_linenumber", F.col("l_returnflag").alias("substrate"), F.col("l_quantity").alias("area"), "l_orderkey")


A = "WITH a AS (SELECT p_brand AS river, p_type AS basin, l_linenumber, l_returnflag AS substrate, l_quantity AS area, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)\n"


@query(P + """, q AS (SELECT rec_id, avg(dep_m) AS a, quantile_cont(dep_m, 0.01) AS q0, quantile_cont(dep_m, 0.25) AS q1, quantile_cont(dep_m, 0.5) AS q2, quantile_cont(dep_m, 0.75) AS q3, quantile_cont(dep_m, 0.99) AS q4 FROM p GROUP BY 1)
SELECT rec_id, round_even(a, 6) AS dep_m_avg, round_even(q0, 6) AS dep_m_whisklo, round_even(q1, 6) AS dep_m_q1, round_even(q2, 6) AS dep_m_q2, round_even(q3, 6) AS dep_m_q3, round_even(q4, 6) AS dep_m_whiskhi FROM q""")
def reach_five_numbers(spark, sf):
    return reach.five_numbers(pings(spark, sf), REC, "dep_m", 6)


@query(P + """, s AS (SELECT *, unnest(CASE WHEN trk_dist = floor(trk_dist / 500) * 500 AND trk_dist >= 500 THEN [CAST(floor(trk_dist / 500) AS BIGINT) - 1, CAST(floor(trk_dist / 500) AS BIGINT)] ELSE [CAST(floor(trk_dist / 500) AS BIGINT)] END) AS stamp FROM p)
SELECT stamp, round(min(dep_m), 4) AS least, round(max(dep_m), 4) AS most, round(avg(dep_m), 4) AS mean, round(stddev_samp(dep_m), 4) AS std, round(var_samp(dep_m), 3) AS var, round(quantile_cont(dep_m, 0.5), 4) AS median, count(*) AS n FROM s GROUP BY 1""")
def reach_stats(spark, sf):
    s = reach.stamps(pings(spark, sf), 500, "trk_dist")
    n = s.groupBy("stamp").agg(F.count("*").alias("n"))
    return reach.window_stats(s, ("stamp",), "dep_m").join(n, "stamp").select("stamp", r("least"), r("most"), r("mean"), r("std"), r("var", 3), r("median"), "n")


@query(P + """, d AS (SELECT *, coalesce(sqrt((e - lag(e) OVER w) * (e - lag(e) OVER w) + (n - lag(n) OVER w) * (n - lag(n) OVER w)), 0) AS s FROM p WINDOW w AS (PARTITION BY rec_id ORDER BY record_num)),
 t AS (SELECT rec_id, sum(s) AS length, arg_min(e, record_num) AS x0, arg_min(n, record_num) AS y0, arg_max(e, record_num) AS x1, arg_max(n, record_num) AS y1 FROM d GROUP BY 1)
SELECT rec_id, round(length, 3) AS length, round(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)), 3) AS line, round(length / nullif(sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)), 0), 3) AS sinuosity FROM t""")
def sinuosity(spark, sf):
    return reach.sinuosity(pings(spark, sf), REC, "record_num").select("rec_id", r("length", 3), r("line", 3), r("sinuosity", 3))


@query(A + """, w AS (SELECT river, sum(CASE WHEN substrate = 'A' THEN area END) AS a, sum(CASE WHEN substrate = 'N' THEN area END) AS n, sum(CASE WHEN substrate = 'R' THEN area END) AS r FROM a GROUP BY 1)
SELECT river, 'a' AS substrate, a AS share FROM w UNION ALL SELECT river, 'n', n FROM w UNION ALL SELECT river, 'r', r FROM w""")
def melt_share(spark, sf):
    w = _areas(spark, sf).groupBy("river").pivot("substrate", ["A", "N", "R"]).agg(F.sum("area")).toDF("river", "a", "n", "r")
    return reach.melt(w, ["river"], ["a", "n", "r"])


@query(A + "SELECT river, sum(CASE WHEN substrate = 'A' THEN area END) AS A, sum(CASE WHEN substrate = 'N' THEN area END) AS N, sum(CASE WHEN substrate = 'R' THEN area END) AS R FROM a GROUP BY 1")
def pivot_river(spark, sf):
    return _areas(spark, sf).groupBy("river").pivot("substrate", ["A", "N", "R"]).agg(F.sum("area"))


@query(A + "SELECT basin, river, sum(area) AS total, count(*) AS n, CAST(grouping(basin) * 2 + grouping(river) AS INTEGER) AS level FROM a GROUP BY GROUPING SETS ((basin, river), (basin), ())")
def basin_grouping_sets(spark, sf):
    return reach.totals(_areas(spark, sf))


@query(A + """SELECT r.river, s.substrate, count(area) AS n, min(area) AS least, max(area) AS most, coalesce(sum(area), 0) AS total FROM (SELECT DISTINCT river FROM a) r CROSS JOIN (SELECT DISTINCT substrate FROM a) s
 LEFT JOIN (SELECT * FROM a WHERE area > 49) b ON b.river = r.river AND b.substrate = s.substrate GROUP BY 1, 2""")
def river_substrate_totals(spark, sf):
    a = _areas(spark, sf)
    return reach.crossed(a.where("area > 49"), a.select("river").distinct(), a.select("substrate").distinct())


@query(A + """, x AS (SELECT river, l_linenumber AS k, sum(area) AS a FROM a WHERE substrate = 'A' GROUP BY 1, 2), y AS (SELECT river, l_linenumber AS k, sum(area) AS b FROM a WHERE substrate = 'R' AND area > 48 GROUP BY 1, 2)
SELECT coalesce(x.river, y.river) AS river, coalesce(x.k, y.k) AS k, a, b, coalesce(a, 0) - coalesce(b, 0) AS diff FROM x FULL JOIN y ON x.river = y.river AND x.k = y.k""")
def diff_full_outer(spark, sf):
    a = _areas(spark, sf).withColumn("k", F.col("l_linenumber"))
    x = a.where("substrate = 'A'").groupBy("river", "k").agg(F.sum("area").alias("v"))
    y = a.where("substrate = 'R' AND area > 48").groupBy("river", "k").agg(F.sum("area").alias("v"))
    return reach.difference(x, y, ("river", "k"), "v")


@query(A + """SELECT basin, cut, count(*) AS n, round(sum(area * (area / 50)), 3) AS hard_area FROM a CROSS JOIN (VALUES (0.2e0), (0.4e0), (0.6e0), (0.8e0)) c(cut) WHERE area / 50 > cut GROUP BY 1, 2""")
def threshold_sweep(spark, sf):
    a = _areas(spark, sf).withColumn("share", F.col("area") / 50)
    return reach.threshold_tally(a, "share", "area", ("basin",)).select("basin", "cut", "n", r("hard_area", 3))


@query(A + """, q AS (SELECT quantile_cont(area, 0.01) AS lo, quantile_cont(area, 0.99) AS hi FROM a) SELECT river, count(*) AS n, sum(area) AS total FROM a, q WHERE area BETWEEN lo AND hi GROUP BY 1""")
def percentile_slice(spark, sf):
    return reach.within_percentiles(_areas(spark, sf), "area").groupBy("river").agg(F.count("*").alias("n"), F.sum("area").alias("total"))


@query("""WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part GROUP BY 1)
SELECT p_partkey FROM part JOIN q USING (p_brand) WHERE p_retailprice > a - 0.1 * (b - a) AND p_retailprice < b + 0.1 * (b - a)""")
def whisker_slice(spark, sf):
    return reach.within_whiskers(table(spark, sf, "part"), "p_retailprice", ("p_brand",), 0.1).select("p_partkey")


@query(A + """, t AS (SELECT river, sum(area) AS t FROM a GROUP BY 1) SELECT a.river, round(coalesce(sum(CASE WHEN substrate = 'A' THEN area END), 0) / any_value(t), 6) AS "A_prop", count(CASE WHEN substrate = 'A' THEN 1 END) AS "A_patch_count",
 round(coalesce(sum(CASE WHEN substrate = 'R' THEN area END), 0) / any_value(t), 6) AS "R_prop", count(CASE WHEN substrate = 'R' THEN 1 END) AS "R_patch_count" FROM a JOIN t ON a.river = t.river GROUP BY 1""")
def substrate_patches(spark, sf):
    return substrate.class_shares(_areas(spark, sf), ("river",), ["A", "R"]).select("river", r("A_prop", 6), "A_patch_count", r("R_prop", 6), "R_patch_count")


@query(P + ", s AS (SELECT rec_id, beam, record_num, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) - 1 AS i FROM p) SELECT rec_id, record_num FROM s WHERE i % 50 = 0")
def every_fiftieth(spark, sf):
    return reach.every(pings(spark, sf), REC, "record_num").select("rec_id", "record_num")


# ---- layout


@query("SELECT url, CAST(nullif(regexp_extract(url, '(\\d+)([.][^./]*)?$', 1), '') AS BIGINT) AS number FROM pages")
def tile_numbers(spark, sf):
    return table(spark, sf, "pages").select("url", waterfall.tile_number(F.col("url")).alias("number"))


@query(P + ", t AS (SELECT rec_id, record_num // 100 AS chunk_id, count(*) AS width FROM p GROUP BY 1, 2) SELECT rec_id, chunk_id, width, CAST(coalesce(sum(width) OVER (PARTITION BY rec_id ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM t")
def strip_offsets(spark, sf):
    t = pings(spark, sf).groupBy("rec_id", F.expr("record_num div 100").alias("chunk_id")).agg(F.count("*").alias("width"))
    return waterfall.strip(t, REC)


# ---- kernels, some of them without a SQL form


@query(P + """, y AS (SELECT rec_id, record_num, dep_m, row_number() OVER (PARTITION BY rec_id ORDER BY record_num) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM p),
 x AS (SELECT CAST(range - 25 AS DOUBLE) AS x FROM range(51)), g AS (SELECT x, 1e0 AS p0, x AS p1, x * x - 650e0 / 3 AS p2, x * x * x - 389.8e0 * x AS p3 FROM x),
 z AS (SELECT sum(p0 * p0) AS z0, sum(p1 * p1) AS z1, sum(p2 * p2) AS z2, sum(p3 * p3) AS z3 FROM g),
 h AS (SELECT CAST(a.x AS BIGINT) + 25 AS r, CAST(b.x AS BIGINT) + 25 AS j, a.p0 * b.p0 / z0 + a.p1 * b.p1 / z1 + a.p2 * b.p2 / z2 + a.p3 * b.p3 / z3 AS w FROM g a, g b, z),
 k AS (SELECT *, CASE WHEN i < 25 THEN i WHEN i >= n - 25 THEN i - (n - 51) ELSE 25 END AS r, CASE WHEN i < 25 THEN 0 WHEN i >= n - 25 THEN n - 51 ELSE i - 25 END AS base FROM y WHERE n >= 51)
SELECT k.rec_id, k.record_num, round(sum(h.w * y.dep_m), 4) AS dep_s FROM k JOIN h ON h.r = k.r JOIN y ON y.rec_id = k.rec_id AND y.i = k.base + h.j GROUP BY 1, 2
UNION ALL SELECT rec_id, record_num, round(dep_m, 4) FROM y WHERE n < 51""")
def depth_savgol(spark, sf):
    """Cubic smoothing over 51 pings; the SQL fits by the orthogonal polynomials of 51 points."""
    return depth.smooth(pings(spark, sf), "dep_m", "dep_s", keys=REC).select("rec_id", "record_num", r("dep_s"))


@query(P.replace("WITH p", "WITH RECURSIVE p", 1) + """, a(rec_id, record_num, v, it) AS (SELECT rec_id, record_num, dep_m, 0 FROM p WHERE dep_m IS NOT NULL UNION ALL
  SELECT rec_id, record_num, v, it + 1 FROM (SELECT *, bool_or(bad) OVER (PARTITION BY rec_id) AS some_bad FROM (
   SELECT *, coalesce(abs(v - lag(v) OVER w) > 40 AND abs(lead(v) OVER w - v) > 40 AND sign(v - lag(v) OVER w) <> sign(lead(v) OVER w - v), false) AS bad FROM a WINDOW w AS (PARTITION BY rec_id ORDER BY record_num))) WHERE some_bad AND NOT bad),
 b AS (SELECT rec_id, record_num, v FROM a QUALIFY it = max(it) OVER (PARTITION BY rec_id)),
 c(rec_id, record_num, v, it) AS (SELECT rec_id, record_num, v, 0 FROM b UNION ALL
  SELECT rec_id, record_num, v, it + 1 FROM (SELECT *, bool_or(bad) OVER (PARTITION BY rec_id) AS some_bad FROM (
   SELECT *, coalesce(step > greatest(40, 6 * quantile_cont(abs(step - mid), 0.5) OVER (PARTITION BY rec_id)), false) AS bad FROM (
    SELECT *, quantile_cont(step, 0.5) OVER (PARTITION BY rec_id) AS mid FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY rec_id ORDER BY record_num)) AS step FROM c)))) WHERE some_bad AND NOT bad),
 d AS (SELECT rec_id, record_num, v FROM c QUALIFY it = max(it) OVER (PARTITION BY rec_id))
SELECT p.rec_id, p.record_num, d.v AS dep_m FROM p LEFT JOIN d ON d.rec_id = p.rec_id AND d.record_num = p.record_num""")
def depth_without_jumps(spark, sf):
    return depth.without_jumps(pings(spark, sf).select("rec_id", "record_num", "dep_m"), floor=40.0, keys=REC)


@query(P.replace("WITH p", "WITH RECURSIVE p", 1) + """, s AS (SELECT rec_id, beam, record_num, dep_m, row_number() OVER (PARTITION BY rec_id ORDER BY record_num, beam) AS i FROM p),
 r(rec_id, i, cycle, seen) AS (SELECT rec_id, i, CAST(0 AS BIGINT), [beam] FROM s WHERE i = 1 UNION ALL
  SELECT s.rec_id, s.i, r.cycle + CASE WHEN list_contains(r.seen, s.beam) THEN 1 ELSE 0 END, CASE WHEN list_contains(r.seen, s.beam) THEN [s.beam] ELSE list_append(r.seen, s.beam) END FROM r JOIN s ON s.rec_id = r.rec_id AND s.i = r.i + 1),
 c AS (SELECT s.*, r.cycle FROM s JOIN r ON s.rec_id = r.rec_id AND s.i = r.i), f AS (SELECT rec_id, cycle, min(record_num) AS first FROM c GROUP BY 1, 2)
SELECT f.rec_id, f.cycle, b.beam, coalesce(c.record_num, f.first) AS record_num, c.dep_m FROM f CROSS JOIN (VALUES ('click'), ('view'), ('purchase'), ('error'), ('signup')) b(beam)
 LEFT JOIN c ON c.rec_id = f.rec_id AND c.cycle = f.cycle AND c.beam = b.beam""")
def missing_ping_cycles(spark, sf):
    return tracks.missing_pings(pings(spark, sf).select("rec_id", "beam", "record_num", "dep_m"), ["click", "view", "purchase", "error", "signup"])


@query()
def track_spline(spark, sf):
    return tracks.smooth(pings(spark, sf).select("rec_id", "record_num", "time_s", "e", "n"), keys=REC)


@query(X.replace("WITH x", "WITH RECURSIVE x", 1) + """, c AS (SELECT gy AS row, gx AS col, CAST(max(l_linenumber) % 3 + 1 AS INTEGER) AS cls FROM x GROUP BY 1, 2),
 g AS (SELECT a.range AS row, b.range AS col, coalesce(c.cls, 0) AS cls FROM range(100) a CROSS JOIN range(100) b LEFT JOIN c ON c.row = a.range AND c.col = b.range), o AS (SELECT range - 1 AS d FROM range(3)),
 n1 AS (SELECT a.row, a.col, b.row AS r, b.col AS c FROM g a CROSS JOIN o y CROSS JOIN o x JOIN g b ON b.row = a.row + y.d AND b.col = a.col + x.d AND b.cls = a.cls),
 n2 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM n1 n JOIN n1 m ON m.row = n.r AND m.col = n.c), n3 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM n2 n JOIN n1 m ON m.row = n.r AND m.col = n.c),
 h AS (SELECT g.*, k < 4 AS hole FROM g JOIN (SELECT row, col, count(*) AS k FROM n3 GROUP BY 1, 2) USING (row, col)),
 s(row, col, cls, hole, it) AS (SELECT row, col, CASE WHEN hole THEN 0 ELSE cls END, hole, 0 FROM h UNION ALL
  SELECT row, col, new, hole, it + 1 FROM (SELECT *, bool_or(new <> cls) OVER () AS some_new FROM (SELECT *, CASE WHEN hole AND cls = 0 THEN greatest(coalesce(lag(cls) OVER a, 0), coalesce(lead(cls) OVER a, 0), coalesce(lag(cls) OVER b, 0), coalesce(lead(cls) OVER b, 0)) ELSE cls END AS new
   FROM s WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row))) WHERE some_new)
SELECT 0 AS tile, c.row, c.col, CAST(s.cls AS INTEGER) AS cls FROM c JOIN s ON s.row = c.row AND s.col = c.col WHERE it = (SELECT max(it) FROM s)""")
def label_sieve(spark, sf):
    """Regions under four cells given to a neighbour. A region of four or more has four cells within three steps of any of its own, which the SQL counts."""
    got = regions.sieve(_class_map(spark, sf, 1), 4, (), tile=64)
    return got.select(F.lit(0).alias("tile"), F.col("gy").alias("row"), F.col("gx").alias("col"), "cls")


def _class_map(spark: SparkSession, sf: str, add: int) -> DataFrame:
    """A class for each pixel that an item lies on."""
    return pixels(spark, sf).groupBy("gx", "gy").agg((F.max("l_linenumber") % 3 + add).cast("int").alias("cls"))


@query(X.replace("WITH x", "WITH RECURSIVE x", 1) + """, c AS (SELECT gy AS row, gx AS col, CAST(max(l_linenumber) % 3 AS INTEGER) AS cls FROM x GROUP BY 1, 2),
 g AS (SELECT a.range AS row, b.range AS col, coalesce(c.cls, 0) AS cls FROM range(100) a CROSS JOIN range(100) b LEFT JOIN c ON c.row = a.range AND c.col = b.range), o AS (SELECT range - 1 AS d FROM range(3)),
 n1 AS (SELECT a.row, a.col, b.row AS r, b.col AS c FROM g a CROSS JOIN o y CROSS JOIN o x JOIN g b ON b.row = a.row + y.d AND b.col = a.col + x.d AND b.cls = a.cls AND a.cls > 0),
 n2 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM n1 n JOIN n1 m ON m.row = n.r AND m.col = n.c), n3 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM n2 n JOIN n1 m ON m.row = n.r AND m.col = n.c),
 k AS (SELECT g.row, g.col, CASE WHEN k >= 4 THEN cls ELSE 0 END AS cls FROM g LEFT JOIN (SELECT row, col, count(*) AS k FROM n3 GROUP BY 1, 2) USING (row, col)),
 b1 AS (SELECT a.row, a.col, b.row AS r, b.col AS c FROM k a CROSS JOIN o y CROSS JOIN o x JOIN k b ON b.row = a.row + y.d AND b.col = a.col + x.d AND abs(y.d) + abs(x.d) < 2 AND b.cls = 0 AND a.cls = 0),
 b2 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM b1 n JOIN b1 m ON m.row = n.r AND m.col = n.c), b4 AS (SELECT DISTINCT n.row, n.col, m.r, m.c FROM b2 n JOIN b2 m ON m.row = n.r AND m.col = n.c),
 h AS (SELECT k.*, coalesce(n < 5, false) AS hole FROM k LEFT JOIN (SELECT row, col, count(*) AS n FROM b4 GROUP BY 1, 2) USING (row, col)),
 s(row, col, cls, hole, it) AS (SELECT row, col, cls, hole, 0 FROM h UNION ALL
  SELECT row, col, new, hole, it + 1 FROM (SELECT *, bool_or(new <> cls) OVER () AS some_new FROM (SELECT *, CASE WHEN hole AND cls = 0 THEN greatest(coalesce(lag(cls) OVER a, 0), coalesce(lead(cls) OVER a, 0), coalesce(lag(cls) OVER b, 0), coalesce(lead(cls) OVER b, 0)) ELSE cls END AS new
   FROM s WINDOW a AS (PARTITION BY row ORDER BY col), b AS (PARTITION BY col ORDER BY row))) WHERE some_new)
SELECT row AS gy, col AS gx, CAST(cls AS INTEGER) AS cls FROM s WHERE it = (SELECT max(it) FROM s) AND cls > 0""")
def map_watershed(spark, sf):
    """A class map without regions under four pixels, its holes under five filled by the classes around them, nearest first; map tiles of 64."""
    return regions.fill_map(_class_map(spark, sf, 0), 4, 5, (), tile=64).select("gy", "gx", "cls")


@query(X.replace("WITH x", "WITH RECURSIVE x", 1) + """, c AS (SELECT gx, gy, CAST(max(l_linenumber) % 3 AS INTEGER) AS cls, CAST(gy AS BIGINT) * 4294967296 + gx + 2147483648 AS id FROM x GROUP BY 1, 2 HAVING max(l_linenumber) % 3 <> 0),
 e AS (SELECT a.id AS u, b.id AS v FROM c a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) JOIN c b ON b.gx = a.gx + dx AND b.gy = a.gy + dy AND b.cls = a.cls),
 reach AS (SELECT id AS a, id AS b FROM c UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b = e.u), g AS (SELECT a AS id, min(b) AS region FROM reach GROUP BY 1),
 q AS (SELECT region, cls, c.id, gx, gy FROM c JOIN g USING (id)), m AS (SELECT region, gx + dx AS vx, gy + dy AS vy, count(*) AS k, sum(bit) AS bits FROM q CROSS JOIN (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) d(dx, dy, bit) GROUP BY 1, 2, 3),
 w AS (SELECT region, sum(CASE WHEN k IN (1, 3) THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) AS corners, sum(CASE WHEN k = 4 THEN 1 ELSE 0 END) AS full FROM m GROUP BY 1),
 t AS (SELECT region, min(cls) AS cls, count(*) AS n FROM q GROUP BY 1), l AS (SELECT g.region, count(*) // 2 AS n FROM e JOIN g ON g.id = e.u GROUP BY 1)
SELECT t.region, t.cls, n_rings, n_corners, perimeter, area_m FROM (SELECT t.region, t.cls, CAST(2 - t.n + coalesce(l.n, 0) - w.full AS INTEGER) AS n_rings, CAST(corners AS BIGINT) AS n_corners, 0.5e0 * (4 * t.n - 2 * coalesce(l.n, 0)) AS perimeter, 0.25e0 * t.n AS area_m FROM t JOIN w USING (region) LEFT JOIN l USING (region)) t""")
def region_rings(spark, sf):
    """Polygons of a class map, stitched from tiles of 16; a region with h holes, joined by sides, has the Euler number 1 - h, which the SQL counts by cells, sides and corners."""
    step = lambda ring: F.transform(ring, lambda p, i: F.abs(p["x"] - F.get(ring, (i + 1) % F.size(ring))["x"]) + F.abs(p["y"] - F.get(ring, (i + 1) % F.size(ring))["y"]))
    total = lambda a, zero: F.aggregate(a, F.lit(zero), lambda x, y: x + y)
    got = regions.outlines(_class_map(spark, sf, 0), 0.5, (), tile=16)
    corners = F.aggregate(F.transform("rings", lambda g: F.size(g).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return got.select("region", "cls", F.size("rings").alias("n_rings"), corners.alias("n_corners"), total(F.flatten(F.transform("rings", step)), 0.0).alias("perimeter"), "area_m")


@query(X + """, c AS (SELECT DISTINCT gx, gy FROM x), m AS (SELECT count(*) AS k, sum(bit) AS bits FROM c CROSS JOIN (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) d(dx, dy, bit) GROUP BY gx + dx, gy + dy),
 s AS (SELECT count(*) AS n FROM c CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy) WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.gx = c.gx + dx AND b.gy = c.gy + dy))
SELECT CAST((SELECT sum(CASE WHEN k IN (1, 3) THEN 1 WHEN bits IN (6, 9) THEN 2 ELSE 0 END) FROM m) AS BIGINT) AS n_corners, 0.5e0 * (SELECT n FROM s) AS perimeter, 0.25e0 * (SELECT count(*) FROM c) AS ring_area, 0.25e0 * (SELECT count(*) FROM c) AS area_m""")
def bankline_totals(spark, sf):
    """Bank lines of all returns at pixels of half a metre, simplified to 0.1 m, which keeps every corner of such pixels; the rings' areas, holes less, are those of the pixels."""
    at = lambda ring, i: F.get(ring, i % F.size(ring))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    side = lambda ring: total(F.transform(ring, lambda p, i: F.abs(p["x"] - at(ring, i + 1)["x"]) + F.abs(p["y"] - at(ring, i + 1)["y"])))
    area = lambda ring: F.abs(total(F.transform(ring, lambda p, i: p["x"] * at(ring, i + 1)["y"] - at(ring, i + 1)["x"] * p["y"]))) / 2
    pixels = table(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("gx"), (F.col("l_suppkey") % 100).alias("gy"))
    got = regions.banklines(pixels, 0.5, tile=16).select(F.posexplode("rings").alias("i", "ring"), F.when(F.col("i") == 0, F.col("area_m")).alias("area_m"))
    signed = F.when(F.col("i") == 0, area(F.col("ring"))).otherwise(-area(F.col("ring")))
    return got.agg(F.sum(F.size("ring")).alias("n_corners"), F.sum(side(F.col("ring"))).alias("perimeter"), F.sum(signed).alias("ring_area"), F.sum("area_m").alias("area_m"))


@query("""WITH c AS (SELECT l_orderkey % 3 AS rec_id, l_orderkey % 2 AS beam, l_orderkey // 5000 AS chunk_id, l_orderkey AS record_num, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS INTEGER) AS row, CAST(l_quantity AS DOUBLE) AS v FROM lineitem),
 w AS (SELECT * FROM c WHERE row >= record_num % 2), z AS (SELECT rec_id, beam, max(chunk_id) AS z FROM w GROUP BY 1, 2),
 m AS (SELECT rec_id, beam, chunk_id, row, avg(nullif(v, 0)) AS cm FROM w JOIN z USING (rec_id, beam) WHERE chunk_id < z GROUP BY 1, 2, 3, 4), g AS (SELECT rec_id, beam, row, avg(cm) AS row_mean FROM m GROUP BY 1, 2, 3), l AS (SELECT rec_id, beam, max(row) AS last FROM g GROUP BY 1, 2),
 f AS (SELECT w.*, v / row_mean AS egn FROM w JOIN l USING (rec_id, beam) LEFT JOIN g ON w.rec_id = g.rec_id AND w.beam = g.beam AND least(w.row, last) = g.row), e AS (SELECT rec_id, min(egn) AS lo, max(egn) AS hi FROM f GROUP BY 1)
SELECT rec_id, beam, chunk_id, record_num, row, round(egn, 6) AS egn, round(255 * coalesce(least(greatest((egn - lo) / nullif(hi - lo, 0) * 255, 0), 255), 0) / 255, 4) AS out FROM f JOIN e USING (rec_id)""")
def gain_on_arrays(spark, sf):
    """The whole correction on sample arrays, an order's items being a ping's samples."""
    o = F.col("l_orderkey")
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"].cast("double"))
    p = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(items.alias("samples"))
    p = p.select((o % 3).alias("rec_id"), (o % 2).alias("beam"), F.expr("l_orderkey div 5000").alias("chunk_id"), o.alias("record_num"), (o % 2).cast("int").alias("bed"), "samples")
    got = egn.returns_of(egn.correct_arrays(p, egn.gains(egn.row_statistics(p))))
    return got.select("rec_id", "beam", "chunk_id", "record_num", "row", r("egn", 6), r("out", 4))


def _stamps(spark: SparkSession, sf: str) -> DataFrame:
    """A window of the map for each supplier, not along its pixels."""
    k = F.col("s_suppkey")
    x, y = (k * 7) % 90 + 0.25, (k * 13) % 80 + 0.75
    return table(spark, sf, "supplier").select(k.alias("stamp"), overlay.rectangle(x, y, x + k % 11 + 3.5, y + k % 5 + 2.25).alias("window"))


@query(X + """, c AS (SELECT gx, gy, CAST(max(l_linenumber) % 3 AS INTEGER) AS cls FROM x GROUP BY 1, 2 HAVING max(l_linenumber) % 3 <> 0),
 w AS (SELECT s_suppkey AS stamp, (s_suppkey * 7) % 90 + 0.25e0 AS x0, (s_suppkey * 13) % 80 + 0.75e0 AS y0, (s_suppkey * 7) % 90 + s_suppkey % 11 + 3.75e0 AS x1, (s_suppkey * 13) % 80 + s_suppkey % 5 + 3e0 AS y1 FROM supplier)
SELECT stamp, cls, round(sum((least(gx + 1, x1) - greatest(gx, x0)) * (least(gy + 1, y1) - greatest(gy, y0))), 6) AS area_m FROM c JOIN w ON gx + 1 > x0 AND gx < x1 AND gy + 1 > y0 AND gy < y1 GROUP BY 1, 2""")
def class_area_in_stamps(spark, sf):
    """Areas of classes inside stamps, from polygons cut by windows; the SQL adds up parts of pixels."""
    shapes = regions.outlines(_class_map(spark, sf, 0), 1.0, (), tile=32)
    return overlay.class_areas(shapes, _stamps(spark, sf), 8.0, ("stamp",)).select("stamp", "cls", r("area_m", 6))


@query(P + """, s AS (SELECT rec_id, record_num, e AS x0, n AS y0, lead(e) OVER w AS x1, lead(n) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY rec_id ORDER BY record_num)),
 k AS (SELECT s_suppkey AS stamp, (s_suppkey * 7) % 90 + 0.25e0 AS l, (s_suppkey * 13) % 80 + 0.75e0 AS b, (s_suppkey * 7) % 90 + s_suppkey % 11 + 3.75e0 AS r, (s_suppkey * 13) % 80 + s_suppkey % 5 + 3e0 AS t FROM supplier),
 j AS (SELECT stamp, rec_id, x1 - x0 AS dx, y1 - y0 AS dy, (l - x0) / nullif(x1 - x0, 0) AS a, (r - x0) / nullif(x1 - x0, 0) AS c, (b - y0) / nullif(y1 - y0, 0) AS d, (t - y0) / nullif(y1 - y0, 0) AS e, x0 BETWEEN l AND r AS inx, y0 BETWEEN b AND t AS iny FROM s JOIN k ON greatest(x0, x1) > l AND least(x0, x1) < r AND greatest(y0, y1) > b AND least(y0, y1) < t),
 f AS (SELECT *, greatest(0, CASE WHEN dx <> 0 THEN least(a, c) WHEN inx THEN 0 ELSE 2 END, CASE WHEN dy <> 0 THEN least(d, e) WHEN iny THEN 0 ELSE 2 END) AS t0, least(1, CASE WHEN dx <> 0 THEN greatest(a, c) ELSE 1 END, CASE WHEN dy <> 0 THEN greatest(d, e) ELSE 1 END) AS t1 FROM j)
SELECT stamp, rec_id, round(sum((t1 - t0) * sqrt(dx * dx + dy * dy)), 4) AS metres FROM f WHERE t0 < t1 GROUP BY 1, 2 HAVING sum((t1 - t0) * sqrt(dx * dx + dy * dy)) > 0.001""")
def track_length_in_stamps(spark, sf):
    """Metres of each recording's track inside each stamp."""
    w = Window.partitionBy("rec_id").orderBy("record_num")
    lines = pings(spark, sf).select("rec_id", F.col("e").alias("x0"), F.col("n").alias("y0"), F.lead("e").over(w).alias("x1"), F.lead("n").over(w).alias("y1"))
    return overlay.lengths(lines, _stamps(spark, sf), 8.0, ("rec_id",), least=0.001, digits=4)


@query(P + """, b AS (SELECT rec_id, CASE beam WHEN 'click' THEN 'ss_port' WHEN 'view' THEN 'ss_star' ELSE beam END AS beam, record_num, speed_ms, row_number() OVER (PARTITION BY rec_id, beam ORDER BY record_num) AS ix FROM p),
 l AS (SELECT rec_id, beam FROM (SELECT rec_id, beam, count(*) AS k FROM b WHERE starts_with(beam, 'ss_') GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY k DESC, beam) = 1),
 o AS (SELECT b.*, ix - lag(ix) OVER w AS step FROM b LEFT JOIN l USING (rec_id) WHERE (NOT starts_with(b.beam, 'ss_') OR b.beam = l.beam) AND coalesce(speed_ms >= 0.5, true) WINDOW w AS (PARTITION BY rec_id, b.beam ORDER BY ix)),
 t AS (SELECT *, CAST(sum(CASE WHEN step <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, beam ORDER BY ix) AS INTEGER) AS transect FROM o), q AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, beam, transect ORDER BY ix) - 1) // 3 AS piece FROM t),
 d AS (SELECT rec_id, beam, record_num, ix, transect, CAST(dense_rank() OVER (PARTITION BY rec_id, beam ORDER BY transect, piece) - 1 AS INTEGER) AS chunk_id FROM q)
SELECT rec_id, beam, record_num, transect, chunk_id FROM d UNION ALL SELECT b.rec_id, b.beam, b.record_num, d.transect, d.chunk_id FROM b JOIN l ON l.rec_id = b.rec_id AND b.beam <> l.beam AND starts_with(b.beam, 'ss_') JOIN d ON d.rec_id = b.rec_id AND d.beam = l.beam AND d.ix = b.ix""")
def read_stage_rows(spark, sf):
    """The rows, transects and chunks of the whole read stage: filtered, numbered, and copied from the longer side to the other."""
    names = F.when(F.col("beam") == "click", "ss_port").when(F.col("beam") == "view", "ss_star").otherwise(F.col("beam"))
    p = survey.Params(nchunk=3, coordinates=False, min_speed=0.5, keep_short=True)
    return survey.read_stage(pings(spark, sf).withColumn("beam", names), p).select("rec_id", "beam", "record_num", "transect", "chunk_id")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
