"""Line dedup by spread over sites: lines that stand on many sites are kept where they come first and removed elsewhere.

Lines are trimmed and hashed. Every line gets a HyperLogLog sketch of its sites; tasks make sketches of what they read, and
sketches are merged by aggregation, so a line on a third of all pages is one small row for each task when it is shuffled.
Lines whose estimate lies clearly above the threshold are boilerplate; only for lines within the sketch's error of it are
(line, site) pairs made and counted exactly. Lines below are settled by the sketch alone. Candidates are joined back to find
where they stand: broadcast if at most ``BROADCAST_LINES`` of them were counted, and joined by shuffle beyond that.

Nulls and odd input: a null text stays null with 0 lines; blank lines are never removed; a null site counts as no site,
though lines may be removed there. First means smallest (doc_id, text hash, position), null doc_id before all; rows that
are equal in doc_id and text share their fate. Texts of very many lines take time in proportion to them. An empty table gives no rows. Other columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_columns, materialise, table, temporary

MOST_SITES = 10
#: log2 of the sketch's registers; its standard error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 12
#: Standard errors, and sites, around the threshold within which lines are counted exactly.
NEAR_ERRORS, NEAR_SITES = 4, 2
BROADCAST_LINES = 200_000
BLANKS = " \t\n\x0b\x0c\r"
LINE = ["_h1", "_h2"]


def _lines(docs: DataFrame) -> DataFrame:
    """(_id, _text_hash, _site, _at, _h1, _h2) of every line that isn't blank."""
    cut = docs.select(
        F.col("doc_id").alias("_id"),
        F.xxhash64("text").alias("_text_hash"),
        F.col("source").alias("_site"),
        F.posexplode(F.split("text", "\n")).alias("_at", "_line"),
    )
    trimmed = F.btrim("_line", F.lit(BLANKS))
    hashed = cut.select("_id", "_text_hash", "_site", "_at", trimmed.alias("_line")).filter("_line <> ''")
    return hashed.select("_id", "_text_hash", "_site", "_at", F.xxhash64("_line").alias("_h1"), F.hash("_line").alias("_h2"))


def line_spread(docs: DataFrame, most_sites: int = MOST_SITES) -> DataFrame:
    """(_h1, _h2, _clear) of lines whose sketch doesn't rule out most_sites sites; _clear: beyond the sketch's error."""
    sketches = _lines(docs).filter("_site is not null").groupBy(*LINE).agg(F.hll_sketch_agg("_site", LOG_REGISTERS).alias("_sketch"))
    margin = max(NEAR_SITES, NEAR_ERRORS * 1.04 / 2 ** (LOG_REGISTERS / 2) * most_sites)
    estimates = sketches.select(*LINE, F.hll_sketch_estimate("_sketch").alias("_sites")).filter(F.col("_sites") >= most_sites - margin)
    return estimates.select(*LINE, (F.col("_sites") > most_sites + margin).alias("_clear"))


def _small(lines: DataFrame) -> DataFrame:
    """Lines as a side to broadcast, if they were counted to be few."""
    return F.broadcast(lines) if lines.count() <= BROADCAST_LINES else lines


def widespread_hits(docs: DataFrame, most_sites: int = MOST_SITES) -> DataFrame:
    """(_id, _text_hash, _at, _h1, _h2): where lines stand that are on most_sites sites or more."""
    candidates = materialise(line_spread(docs, most_sites), "lines")
    hits = materialise(_lines(docs).join(_small(candidates), LINE), "line-hits")
    near = hits.filter(~F.col("_clear") & F.col("_site").isNotNull()).select(*LINE, "_site").distinct()
    counted = materialise(near.groupBy(*LINE).count().filter(F.col("count") >= most_sites).select(*LINE), "lines-counted")
    where = ["_id", "_text_hash", "_at", *LINE]
    return hits.filter("_clear").select(*where).union(hits.filter(~F.col("_clear")).join(_small(counted), LINE).select(*where))


def _removals(docs: DataFrame, most_sites: int) -> DataFrame:
    """(__id, __hash, __removed): positions of the lines to remove from each document that has any."""
    with temporary(docs.sparkSession) as result:
        doc = ["_id", "_text_hash"]
        hits = widespread_hits(docs, most_sites)
        first = materialise(hits.groupBy(*LINE).agg(F.min(F.struct(*doc, "_at")).alias("_first")), "line-firsts")
        repeats = hits.join(_small(first), LINE).filter(~F.struct(*doc, "_at").eqNullSafe(F.col("_first")))
        removed = repeats.groupBy(F.col("_id").alias("__id"), F.col("_text_hash").alias("__hash")).agg(F.collect_set("_at").alias("__removed"))
        return result(removed, "line-removals")


@keeps_columns("_n_lines", "_n_removed")
def dedup_lines(docs: DataFrame, most_sites: int = MOST_SITES) -> DataFrame:
    """The input's columns with text cut, and _n_lines, _n_removed (long)."""
    removed = _removals(docs, most_sites)
    joined = docs.join(removed, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")), "left")
    # the array of lines is used more than once, which keeps Spark from splitting the text for each of them
    cut = joined.select(*(docs[c] for c in docs.columns), F.split("text", "\n").alias("__lines"), "__removed")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__removed")
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda at: F.get("__lines", at)), "\n"))
    return cut.select(
        *(text.alias(c) if c == "text" else c for c in docs.columns),
        F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("_n_lines"),
        F.when(F.col("__removed").isNull(), 0).otherwise(F.size("__removed")).cast("long").alias("_n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cut.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text"), 256).alias("text_sha256"))


#: Of documents d(doc_id, text, source): lines to keep, as SQL for DuckDB.
LINES_SQL = f"""
cut AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, source, pos, lines[pos] AS line, trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM cut, unnest(range(1, len(lines) + 1)) AS u(pos)),
flagged AS (SELECT trimmed FROM lines WHERE trimmed <> '' GROUP BY trimmed HAVING count(DISTINCT source) >= {MOST_SITES}),
ranked AS (
  SELECT lines.*, flagged.trimmed IS NOT NULL AND row_number() OVER (PARTITION BY lines.trimmed ORDER BY doc_id, pos) > 1 AS removed
  FROM lines LEFT JOIN flagged ON lines.trimmed = flagged.trimmed),
cleaned AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS text
  FROM ranked GROUP BY doc_id)"""
OP9_SQL = f"""
WITH d AS (SELECT doc_id, text, source FROM documents), {LINES_SQL}
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(cleaned.text) AS text_sha256
FROM d LEFT JOIN cleaned USING (doc_id)
"""
