"""Secret scans by linking the parts of multipart credentials (DataFrame operations only).

Three kinds are reported wherever they stand (assign, access, hex). Four weak kinds are
candidates that alone mean little: `id` (a named account or key identifier), `key` (a long
mixed run of key characters), `pass` (an assignment with a short value) and `endpoint`
(a connection address). A weak part is reported only with a part of a complementary role in
its scope, which is the text within `reach` code points on either side of it.

1. One pass over the texts takes the matches of every pattern as lengths: of each match and
   of the text before it. Texts without a match stop at cheap tests.
2. Matches become rows, keyed by the text's md5, so copies of a text count once. Running sums
   over a text's matches give intervals of code points.
3. Weak parts that overlap a base part go, by running ends and starts of base parts. The others
   meet parts of a complementary role in an interval join on cells of `reach` code points
   (a semi-join on text, cell and role, and on the gap). Matches of one kind never overlap,
   so a cell holds a bounded number of them.
4. Spans are gathered per text once and joined back by its md5.

Every step is linear in the texts and their matches. No text is shuffled for a report; redact()
shuffles only the texts that have a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import remove, written

#: Fixed values. Kinds in reporting order; each pattern is scanned leftmost, non-overlapping.
BASE = ("assign", "access", "hex")
WEAK = ("id", "key", "pass", "endpoint")
KINDS = BASE + WEAK
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ID = r"""(access_key_id|access_id|client_id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
KEY = r"[A-Za-z0-9+/_]{32,}"
ENDPOINT = r"(https?|ftp|ssh|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@%&=+-]+"
#: What every part has: an assignment or an address, of which the text must have a sign, or a long run, of which the first 16 must be there.
SIGNS, ASSIGNED = (":", "="), r"""[A-Za-z]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]|://"""
START, RUN = r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_]{16}", r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}|[A-Za-z0-9+/_]{32}"
#: A weak identifier or endpoint needs a secret in reach, a weak secret one of these.
ROLES = {"assign": "s", "access": "i", "hex": "s", "id": "i", "key": "s", "pass": "s", "endpoint": "e"}
#: Pattern, kind, and the group whose length counts (0: none).
PATTERNS = ((ASSIGN, "assign", 2), (ACCESS, "access", 0), (HEX, "hex", 0), (ID, "id", 0), (KEY, "key", 0), (ENDPOINT, "endpoint", 0))
MATCH = "array<struct<kind:int,i:int,gap:int,len:int,value:int>>"
#: Code points of a block of a text; a cut reads one or two blocks, so cutting is linear in the text.
BLOCK = 1024


def some_part(text: Column) -> Column:
    """Whether a text can have a part; false for null. The cheap test of each pair spares most texts the other."""
    signs = text.contains(SIGNS[0]) | text.contains(SIGNS[1])
    return F.coalesce((signs & text.rlike(ASSIGNED)) | (text.rlike(START) & text.rlike(RUN)), F.lit(False))


def _matches(text: Column) -> Column:
    """(kind, i, gap before, len, value) of each pattern's matches: an array, empty where some_part() is false."""
    lens = lambda a: F.transform(a, F.length)

    def of(pattern: str, kind: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        value = lens(F.regexp_extract_all(text, F.lit(pattern), group)) if group else lens(found)
        rows = F.filter(F.arrays_zip(lens(F.split(text, pattern, -1)).alias("gap"), lens(found).alias("len"), value.alias("value")), lambda x: x["len"].isNotNull())
        k = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(rows, lambda x, i: F.struct(k, i.alias("i"), x["gap"].alias("gap"), x["len"].alias("len"), x["value"].alias("value")))

    none = F.array().cast(MATCH)
    return F.when(some_part(text), F.concat(*(of(*p).cast(MATCH) for p in PATTERNS))).otherwise(none)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def parts(found: DataFrame, short: int = 12) -> DataFrame:
    """(key, matches) -> key, kind (number into KINDS), start, end: one row per part of each distinct text."""
    rows = found.select("key", F.inline("matches"))
    once = rows.groupBy("key", "kind", "i").agg(*(F.max(c).alias(c) for c in ("gap", "len", "value")))
    upto = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    at = once.withColumn("end", upto.cast("int")).withColumn("start", F.col("end") - F.col("len"))
    assign, weak = KINDS.index("assign"), KINDS.index("pass")
    kind = F.when((F.col("kind") != assign) | (F.col("value") >= short), F.col("kind")).when(F.col("value") >= 4, F.lit(weak))
    return at.select("key", kind.alias("kind"), "start", "end").where("kind IS NOT NULL")


def _is_secret(kind: Column) -> Column:
    """Whether a kind's role is the secret; the complement of that role is an identifier or an endpoint."""
    return kind.isin([KINDS.index(k) for k, role in ROLES.items() if role == "s"])


def _cells(rows: DataFrame, lo: Column, hi: Column, width: int) -> DataFrame:
    """rows with `cell`: once for each cell of `width` code points that lo..hi touches."""
    cell = lambda x: F.greatest(F.floor(x / width), F.lit(0)).cast("int")
    return rows.withColumn("cell", F.explode(F.sequence(cell(lo), cell(hi))))


def linked(all_parts: DataFrame, reach: int = 200) -> DataFrame:
    """The weak parts (key, kind, start, end) that have a complementary part at most `reach` code points away and overlap no base part."""
    width = max(reach, 1)
    base = F.when(F.col("kind") < len(BASE), F.struct("start", "end"))
    upto = lambda order: Window.partitionBy("key").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.max(base["end"]).over(upto(F.asc("start"))), F.min(base["start"]).over(upto(F.desc("start")))
    flagged = all_parts.withColumns({"before": before, "after": after})
    weak = flagged.where((F.col("kind") >= len(BASE)) & ~F.coalesce(F.col("before") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("after") < F.col("end"), F.lit(False)))
    other = _cells(all_parts, F.col("start"), F.col("end"), width).select("key", "cell", _is_secret(F.col("kind")).alias("secret"), F.col("start").alias("a"), F.col("end").alias("b"))
    mine = _cells(weak.select("key", "kind", "start", "end"), F.col("start") - reach, F.col("end") + reach, width).withColumn("needs", ~_is_secret(F.col("kind")))
    meet = (mine["key"] == other["key"]) & (mine["cell"] == other["cell"]) & (mine["needs"] == other["secret"])
    near = mine.join(other, meet & (other["a"] - mine["end"] <= reach) & (mine["start"] - other["b"] <= reach), "left_semi")
    return near.select("key", "kind", "start", "end").distinct()


def spans(all_parts: DataFrame, reach: int = 200) -> DataFrame:
    """key, kind, start, end of every reported span: the base parts and the linked weak ones. all_parts is read several times."""
    return all_parts.where(F.col("kind") < len(BASE)).unionByName(linked(all_parts, reach).select(all_parts.columns))


def _said(a: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, reach: int = 200) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked: one row per input row.

    Offsets are code points, ends exclusive; spans are in order of start, then kind. Null,
    empty and blank texts have none; a text of any length is read whole; repeated rows are
    reported each; an empty table gives no rows; other columns are ignored.
    """
    some = some_part(F.col("text"))
    # Rows without a part get a key that no text has, all different, so that no task meets them all.
    alone = F.concat(F.lit("a text without parts: "), F.monotonically_increasing_id().cast("string")).cast("binary")
    found = written(docs.select("doc_id", F.when(some, _key(F.col("text"))).otherwise(alone).alias("key"), _matches(F.col("text")).alias("matches")), "secret-matches")
    told = spans(written(parts(found), "secret-parts"), reach).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    base = F.filter("all", lambda x: x["kind"] < len(BASE))
    n = lambda kind: F.size(F.filter("all", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    told = told.select("key", *(n(k).alias(f"n_{k}") for k in BASE), _said(base).alias("base"), _said(F.col("all")).alias("spans"), (F.size("all") - F.size(base)).cast("long").alias("n_linked"))
    out = found.select("doc_id", "key").join(told, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", *(zero(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_linked"))


def _piece(blocks: Column, a: Column, b: Column) -> Column:
    """Code points a..b (exclusive) of a text in blocks of BLOCK."""
    i, j = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
    inner = lambda k, x, n: F.substring(F.get(blocks, k), x, n)
    several = F.concat(inner(i, a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, j - i - 1), ""), inner(j, F.lit(1), (b - 1) % BLOCK + 1))
    return F.when(b <= a, F.lit("")).when(i == j, inner(i, a % BLOCK + 1, b - a)).otherwise(several)


def redact(docs: DataFrame, reach: int = 200, mark: str = "[SECRET]", count: str = "n_chars") -> DataFrame:
    """docs with every reported span of the text replaced by mark (overlapping spans by one); other texts stay as they are.

    A column named by `count`, if there is one, gets the new length of the texts that change.
    Null, empty and blank texts stay; repeated rows all stay; an empty table stays empty;
    all columns are kept.
    """
    text = docs["text"]
    found = written(docs.where(some_part(text)).select(_key(text).alias("key"), _matches(text).alias("matches")), "secret-matches")
    all_parts = written(parts(found), "secret-parts")
    order = Window.partitionBy("key").orderBy("start", "kind")
    cut = spans(all_parts, reach).withColumn("at", F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fresh = F.when(F.col("start") >= F.col("at"), F.struct("start", "at"))
    cuts = written(cut.groupBy("key").agg(F.sort_array(F.collect_list(fresh)).alias("cuts"), F.max("end").alias("last")), "secret-cuts")
    remove(found)
    remove(all_parts)
    rows = docs.where(some_part(text)).select(F.struct("*").alias("row"), text.alias("text"), _key(text).alias("key")).join(cuts, "key", "left")

    def cleaned(x: Column) -> Column:
        kept = F.transform(x["cuts"], lambda c: F.concat(_piece(x["blocks"], c["at"], c["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _piece(x["blocks"], x["last"], x["long"]))

    bound = F.struct(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), 0).alias("blocks"), "cuts", "last", F.length("text").alias("long"))
    some = F.col("cuts").isNotNull()
    new = F.when(some, F.transform(F.array(bound), cleaned)[0]).otherwise(F.col("text"))
    out = rows.select("row", new.alias("new"), some.alias("some"))
    row = F.col("row").withField("text", F.col("new"))
    if count in docs.columns:
        row = row.withField(count, F.when(F.col("some"), F.length("new").cast(docs.schema[count].dataType)).otherwise(F.col("row")[count]))
    return docs.where(~some_part(text)).unionByName(out.select(row.alias("row")).select("row.*"))
