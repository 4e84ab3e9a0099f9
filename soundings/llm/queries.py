"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, embeddings, languages, licences, minhash, mixing, pieces, repetition, rules, secrets, sharding, urlfilter, variants
from ._shared import written

#: Fixed values: (verdict, host, path).
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.groups(_read(spark, sf_dir, "embeddings"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def licence_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3_licences that SQL can state: words and base phrases."""
    return op3_licences(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(_read(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    return urlfilter.judge(pages, URL_RULES, written(urlfilter.link_farms(pages), "url-list"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(_read(spark, sf_dir, "documents"), n=2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(_read(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_embeddings, op2_sharding, op3_licences, licence_places, op4_repetition, op5_url_filter, op6_secrets, op7_pieces, op8_quality, op9_mixing, op10_minhash, op11_divergence, op12_languages, op13_variants)
    return {f.__name__: f for f in every}


_VECTORS = """ok AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
 AND list_aggregate(list_transform(embedding, lambda e: CASE WHEN e IS NULL OR isnan(e) OR isinf(e) THEN 1 ELSE 0 END), 'max') = 0 AND list_aggregate(list_transform(embedding, lambda e: abs(e)), 'max') > 0),
 link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a, ok b WHERE a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.95)"""

ORACLES = {
    "op1_embeddings": f"""WITH RECURSIVE {_VECTORS}, reach AS (SELECT u AS a, u AS b FROM link UNION SELECT r.a, l.v FROM reach r JOIN link l ON r.b = l.u),
 root AS (SELECT a, min(b) AS c FROM reach GROUP BY 1), n AS (SELECT u, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c, e.vec_id) AS component_id, coalesce(c, e.vec_id) = e.vec_id AS kept FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN root ON root.a = e.vec_id""",
    "licence_places": r"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 i AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM w), n AS (SELECT doc_id, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM i WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 p AS (SELECT doc_id, i, CASE WHEN x = 'mit' AND y = 'license' THEN 'mit' WHEN x = 'apache' AND y = 'license' THEN 'apache' WHEN x = 'general' AND y = 'public' AND z = 'license' THEN 'gpl' END AS label FROM n),
 b AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(b.labels, '') AS base_labels FROM w LEFT JOIN b USING (doc_id)""",
    "op4_repetition": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
 i AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
 g AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g, hash(list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)) AS h, count(*) OVER (PARTITION BY doc_id) - i AS after FROM i),
 r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g WHERE after >= 4) WHERE k > 1),
 c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT r.doc_id, r.i + s.k AS p FROM r CROSS JOIN (VALUES (0), (1), (2), (3), (4)) s(k)) GROUP BY 1),
 l AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, h FROM g WHERE after >= 50 GROUP BY 1, 2 HAVING count(*) > 1)),
 z AS (SELECT doc_id, len(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')))) AS n FROM d),
 o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(z.n AS BIGINT) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, l.doc_id IS NOT NULL AS long FROM w JOIN z USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT long AS kept FROM o""",
    "op5_url_filter": r"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
 r(said, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
 f AS (SELECT page_id, p.host, p.path, arg_max(h || r.p, length(h) + length(r.p)) AS rule, arg_max(said, length(h) + length(r.p)) AS said FROM p LEFT JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.p) GROUP BY 1, 2, 3),
 w AS (SELECT translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(html, '') AS t FROM pages),
 l AS (SELECT host FROM w WHERE host <> '' GROUP BY 1 HAVING sum((length(t) - length(replace(t, '<a ', ''))) // 3) * 1000 > 5 * sum(length(t)))
SELECT page_id, f.host, f.path, rule, coalesce(said, CASE WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.host IS NOT NULL AS in_list FROM f LEFT JOIN l ON f.host = l.host""",
    "op9_mixing": r"""WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
 s AS (SELECT k, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w FROM d GROUP BY 1),
 t AS (SELECT *, (SELECT sum(s) FROM s) AS total, (SELECT sum(w) FROM s) AS all_w FROM s),
 l AS (SELECT *, (total - coalesce(sum(3 * s) OVER b, 0)) / CAST(all_w - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level FROM t WINDOW b AS (ORDER BY 3 * s / CAST(w AS DOUBLE), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, 3 * s <= level * w AS capped FROM l), m AS (SELECT arg_min(level, 3 * s / CAST(w AS DOUBLE)) AS line FROM f WHERE NOT capped),
 g AS (SELECT k, s, CASE WHEN capped OR line IS NULL THEN CAST(3 * s AS DOUBLE) ELSE least(line * w, CAST(3 * s AS DOUBLE)) END AS target FROM f, m),
 o AS (SELECT d.*, s, target, CAST(round(target) AS BIGINT) AS goal, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a FROM d JOIN g USING (k))
SELECT doc_id, size, s AS source_size, target, CAST(greatest(least(a + size, goal) - a, 0) + greatest(least(a + s + size, goal) - (a + s), 0) + greatest(least(a + 2 * s + size, goal) - (a + 2 * s), 0) AS BIGINT) AS taken FROM o""",
    "op10_minhash": r"""WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     ')), ' +') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN CASE WHEN w[1] = '' THEN [] ELSE [w[1]] END ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
 x AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS t FROM g), df AS (SELECT t, count(*) AS df FROM x GROUP BY 1),
 p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS i FROM x JOIN df USING (t)), q AS (SELECT * FROM p WHERE i <= n - (n * 80 + 99) // 100 + 1),
 c AS (SELECT DISTINCT a.doc_id AS u, b.doc_id AS v FROM q a JOIN q b ON a.t = b.t AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
 k AS (SELECT u, v FROM c JOIN g a ON a.doc_id = u JOIN g b ON b.doc_id = v WHERE 100 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
 e AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k), reach AS (SELECT u AS a, u AS b FROM e UNION SELECT r.a, e.v FROM reach r JOIN e ON r.b = e.u), root AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(c, g.doc_id) AS component_id, coalesce(c, g.doc_id) = g.doc_id AS kept FROM g LEFT JOIN root ON root.a = g.doc_id""",
    "op11_divergence": r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d), k AS (SELECT lang, w, count(*) AS m FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
 l AS (SELECT lang, count(*) AS v, CAST(sum(m) AS BIGINT) AS n FROM k GROUP BY 1), c AS (SELECT lang, source, w, count(*) AS n FROM w SEMI JOIN k USING (lang, w) GROUP BY 1, 2, 3),
 g AS (SELECT lang, source, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
 p AS (SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + v) AS p, 1 + (1000000000 * (m + 1)) // (l.n + v) AS q FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
 s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', w, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM o) WHERE part = 'pair' OR rank <= 200""",
    "op13_variants": r"""WITH RECURSIVE t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
 r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
 u AS (SELECT d, w, count(*) AS n, list_transform(string_split(d || ':' || w, ''), lambda c: unicode(c)) AS p FROM r WHERE length(w) >= 7 GROUP BY 1, 2),
 h AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [CAST(c AS BIGINT)] ELSE [195, CAST(c - 64 AS BIGINT)] END))), lambda c, b: xor(t.t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h FROM u, t),
 v AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM h), f AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 x AS (SELECT w, n, i, w[1:i - 1] || w[i + 1:] AS s FROM f, LATERAL (SELECT unnest(range(1, length(w) + 1)) AS i)),
 e AS (SELECT a.w, b.w AS o, b.n FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.w <> b.w UNION SELECT x.w, f.w, f.n FROM x JOIN f ON x.s = f.w UNION SELECT f.w, x.w, x.n FROM x JOIN f ON x.s = f.w),
 b AS (SELECT w, count(*) AS n_near, max(n) AS m FROM e GROUP BY 1), c AS (SELECT e.w, min(e.o) AS o FROM e JOIN b ON b.w = e.w AND b.m = e.n GROUP BY 1),
 z AS (SELECT f.w, f.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * f.n THEN o END AS form, CASE WHEN m >= 10 * f.n THEN m END AS form_n FROM f LEFT JOIN b ON b.w = f.w LEFT JOIN c ON c.w = f.w),
 y AS (SELECT w, w AS o, 0 AS k FROM z UNION ALL SELECT y.w, z.form, k + 1 FROM y JOIN z ON z.w = y.o WHERE z.form IS NOT NULL)
SELECT z.w AS word, form, root, n, n_near, form_n FROM z JOIN (SELECT w, arg_max(o, k) AS root FROM y GROUP BY 1) q ON q.w = z.w""",
}


def _secret_sql() -> str:
    """Matches come as lists of texts; their places follow from the lengths of the pieces between them."""
    parts = []
    for kind, pattern, group in (("assign", secrets.ASSIGN, 2), ("access", secrets.ACCESS, 0), ("hex", secrets.HEX, 0), ("id", secrets.ID, 0), ("key", secrets.KEY, 0), ("endpoint", secrets.ENDPOINT, 0)):
        p = pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, '{kind}' AS src, unnest(m) AS m, unnest(v) AS v, unnest(p[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i
 FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS p FROM d)"""
        )
    kinds = ", ".join(f"('{k}', {i}, '{secrets.ROLES[k]}')" for i, k in enumerate(secrets.KINDS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({' UNION ALL '.join(parts)}),
 b AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, src ORDER BY i ROWS UNBOUNDED PRECEDING) AS stop FROM a),
 s AS (SELECT doc_id, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CASE WHEN src = 'assign' AND length(v) < 12 THEN CASE WHEN length(v) >= 4 THEN 'pass' END ELSE src END AS kind FROM b),
 k(kind, no, role) AS (VALUES {kinds}), x AS (SELECT s.*, no, role FROM s JOIN k USING (kind)), base AS (SELECT * FROM x WHERE no < 3),
 near AS (SELECT DISTINCT w.doc_id, w.start, w.stop, w.kind, w.no, w.role FROM x w JOIN x o ON o.doc_id = w.doc_id AND greatest(o.start - w.stop, w.start - o.stop) <= 200
  AND ((w.role IN ('i', 'e') AND o.role = 's') OR (w.role = 's' AND o.role IN ('i', 'e'))) WHERE w.no >= 3),
 weak AS (SELECT * FROM near w WHERE NOT EXISTS (SELECT 1 FROM base o WHERE o.doc_id = w.doc_id AND o.start < w.stop AND w.start < o.stop)),
 said AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM weak) GROUP BY 1),
 told AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans, count(CASE WHEN no = 0 THEN 1 END) AS a, count(CASE WHEN no = 1 THEN 1 END) AS c, count(CASE WHEN no = 2 THEN 1 END) AS h FROM base GROUP BY 1),
 extra AS (SELECT doc_id, count(*) AS n FROM weak GROUP BY 1)
SELECT d.doc_id, coalesce(told.a, 0) AS n_assign, coalesce(told.c, 0) AS n_access, coalesce(told.h, 0) AS n_hex, sha256(coalesce(told.spans, '')) AS base_sha256, coalesce(said.spans, '') AS spans, coalesce(extra.n, 0) AS n_linked
 FROM d LEFT JOIN told USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN extra USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB equivalents; those of op2, op3, op7, op8 and op12 grow trees, automata and models, which SQL cannot state, and are tested against brute force instead."""
    return {**ORACLES, "op6_secrets": _secret_sql()}
