"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans stand alone: assignments of long values, access identifiers, long hexadecimal strings. Weak parts do not: an
account or key name (``id``), a short or oddly named value (``secret``), an address (``endpoint``). They are reported only
where a complementary part starts within ``REACH`` code points in the same text: an id or an endpoint next to a secret of
any strength, a weak secret next to an id or an endpoint (base access spans count as ids, other base spans as secrets).

Places come from cutting a text at its matches: the lengths of the pieces between and of the matches, summed up in turn,
are the borders. Linking is an interval join: a text is a scope, cut into cells of ``REACH`` code points. A cell's parts are
first summed up to the first and last start of each role; weak parts then join the summaries of their own cell and the two
beside it. So a part meets three summaries however many parts lie around it.

The lengths of all texts' matches are written to the shared folder with a number for each row, which all later steps go by;
copies and rows that repeat an id are rows like any other, so no key is hot. For redaction the texts are written with them, so
that patterns run over each text once.

Defined results: null text is empty; every row gets its own result, whether its id is null or repeated; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, stored

REACH = 240
#: Kinds in order, the base ones first: pattern, group of the value, code points it needs, role, whether it is weak.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8, "secret", False),
    "access": (r"AKIA[A-Z0-9]+", 0, 16, "id", False),
    "hex": (r"[0-9a-f]{32,}", 0, 32, "secret", False),
    "id": (r"""(?i:(user_?name|user|login|account|access_?key_?id|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]+))""", 2, 3, "id", True),
    "secret": (r"""(?i:(password|passwd|secret|token|api_?key|private_?key|access_?key|passphrase|credential|auth|pass|pwd)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 4, "secret", True),
    "endpoint": (r"(?i:(https?|ftp|ssh|jdbc|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+)", 0, 10, "endpoint", True),
}
RANKS = {kind: i for i, kind in enumerate(KINDS)}
ROLES = ("id", "secret", "endpoint")
#: What every text with a match has.
MAYBE = r"(?i:password|passwd|secret|token|api_?key|akia|user|login|account|key_?id|client_?id|access_?key|private_?key|passphrase|credential|auth|pass|pwd|://)|[0-9a-f]{32}"
MARK = "[REDACTED]"


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda x: F.length(x))


def _found(text: Column, kind: str) -> Column:
    """For each match of a kind: the code points between it and the one before, its own and its value's."""
    pattern, group, _, _, _ = KINDS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    own = F.transform(matches, lambda x: F.struct(F.length(x).alias("size"), (F.length(F.regexp_extract(x, pattern, group)) if group else F.length(x)).alias("value")))
    zipped = F.zip_with(_lengths(F.split(text, pattern)), own, lambda gap, x: F.struct(gap.alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.filter(zipped, lambda x: x["size"].isNotNull())


def _parts(numbered: DataFrame) -> DataFrame:
    """(row, rank, start, end, role, weak) of all matches whose values are long enough."""
    each = numbered.filter("found is not null").select("row", F.posexplode("found").alias("rank", "matches")).select("row", "rank", F.posexplode("matches").alias("at", "m"))
    upto = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select("row", "rank", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int").alias("end"), F.col("m.size").alias("size"), F.col("m.value").alias("value"))
    least, role, weak = (F.element_at(F.array(*(F.lit(k[i]) for k in KINDS.values())), F.col("rank") + 1) for i in (2, 3, 4))
    placed = placed.filter(F.col("value") >= least).select("row", "rank", (F.col("end") - F.col("size")).alias("start"), "end", role.alias("role"), weak.alias("weak"))
    best = F.min("rank").over(Window.partitionBy("row", "start"))  # what a base assignment is, is not a weak secret too
    return placed.withColumn("best", best).filter((F.col("rank") != RANKS["secret"]) | (F.col("best") != RANKS["assign"])).drop("best")


def _linked(parts: DataFrame, reach: int) -> DataFrame:
    """(row, rank, start, end) of the weak parts with a complementary part within reach."""
    celled = parts.withColumn("cell", F.floor(F.col("start") / reach))
    ends = [f(F.when(F.col("role") == r, F.col("start"))).alias(f"{n}_{r}") for r in ROLES for n, f in (("first", F.min), ("last", F.max))]
    summary = celled.groupBy("row", "cell").agg(*ends)
    asking = celled.filter("weak").select("row", "rank", "start", "end", "role", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = {r: F.coalesce(F.abs(F.col(f"first_{r}") - F.col("start")) <= reach, F.lit(False)) | F.coalesce(F.abs(F.col(f"last_{r}") - F.col("start")) <= reach, F.lit(False)) for r in ROLES}
    completes = F.when(F.col("role") == "secret", near["id"] | near["endpoint"]).otherwise(near["secret"])
    return asking.join(summary, ["row", "cell"]).filter(completes).select("row", "rank", "start", "end").distinct()


def _matches(text: Column) -> Column:
    """The matches of every kind in a text; null for most texts without any."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike(MAYBE), F.array(*(_found(text, k) for k in KINDS)))


def _by_row(numbered: DataFrame, reach: int) -> DataFrame:
    """(row, spans, cuts) of the rows that have spans. numbered: (row, found)."""
    parts = checkpointed(_parts(numbered))
    spans = parts.filter("not weak").select("row", "rank", "start", "end").unionByName(_linked(parts, reach))
    before = Window.partitionBy("row").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") < F.max("end").over(before), 0).otherwise(1)
    island = F.sum("fresh").over(Window.partitionBy("row").orderBy("start", "end", "rank").rowsBetween(Window.unboundedPreceding, 0))
    islands = spans.withColumn("fresh", fresh).withColumn("island", island)
    cuts = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.collect_list(F.struct("start", "rank", "end")).alias("spans"))
    return cuts.groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """For each row of df: id_col, spans (array of start, rank of the kind, end; in order) and cuts (array of start, end:
    what the spans cover, without overlaps)."""
    numbered = checkpointed(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), _matches(F.col(text_col)).alias("found")))
    return numbered.select("row", "id").join(_by_row(numbered.select("row", "found"), reach), "row", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>")).alias("spans"),
        F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int>>")).alias("cuts"),
    )


def redacted(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """docs with ``MARK`` in the place of every span; columns and rows as they were. Only texts with matches are shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    held = stored(docs.toDF(*names).withColumns({"row": F.monotonically_increasing_id(), "found": _matches(F.col(text))}), "secrets")
    matched = F.coalesce(F.size(F.flatten("found")) > 0, F.lit(False))
    cuts = _by_row(held.select("row", "found").filter(matched), reach).select("row", "cuts")
    joined = held.filter(matched).drop("found").join(cuts, "row", "left")
    n = F.size("cuts")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"])
    end = lambda i: F.when(i == n, F.length(text)).otherwise(F.get("cuts", i)["start"])
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(F.col(text), begin(i) + 1, end(i) - begin(i)))
    clean = F.when(F.col("cuts").isNotNull(), F.array_join(pieces, MARK)).otherwise(F.col(text))
    done = joined.withColumn(text, clean).select(names)
    return held.filter(~matched).select(names).unionByName(done).toDF(*docs.columns)


def _told(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: spans of secrets in every document."""
    found = scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["rank"] < 3)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["rank"] == RANKS[kind])).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


def _sql() -> str:
    def matches(kind: str) -> str:
        pattern, group, least, role, weak = KINDS[kind]
        pattern = pattern.replace("'", "''")
        return f"""SELECT r, {RANKS[kind]} AS rank, '{role}' AS role, {weak} AS weak, {least} AS least,
    list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gap,
    list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS size,
    list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS value FROM d"""

    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(matches(k) for k in KINDS)}),
e AS (SELECT *, unnest(range(1, len(size) + 1)) AS i FROM m WHERE len(size) > 0),
p0 AS (SELECT r, rank, role, weak, list_sum(gap[1:i]) + coalesce(list_sum(size[1:i - 1]), 0) AS s, size[i] AS n FROM e WHERE value[i] >= least),
p AS (SELECT r, rank, role, weak, s::BIGINT AS s, (s + n)::BIGINT AS e FROM p0 WHERE NOT (rank = 4 AND EXISTS (SELECT 1 FROM p0 q WHERE q.r = p0.r AND q.s = p0.s AND q.rank = 0))),
linked AS (
  SELECT * FROM p WHERE NOT weak OR EXISTS (
    SELECT 1 FROM p q WHERE q.r = p.r AND abs(q.s - p.s) <= {REACH} AND CASE WHEN p.role = 'secret' THEN q.role IN ('id', 'endpoint') ELSE q.role = 'secret' END)),
told AS (
  SELECT r, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
    string_agg({kinds}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg({kinds}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM linked GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)
"""


SQL = _sql()
