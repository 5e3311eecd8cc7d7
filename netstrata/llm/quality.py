"""Quality rules: a table of thresholds compiled into one projection of counts and ratios, without user functions.

``measures`` adds counts of a document's text; ``RULES`` bounds ratios of counts; ``verdict`` turns the table into one
boolean expression of integer comparisons, so results don't depend on rounding.

Repeated words: the words are cut into all windows of eight, each window is hashed (64 bits), equal hashes count as equal
windows, and words in any window that occurs twice or more are counted once. Texts without a repeated window skip the
sort. All of it works inside a row, so nothing is shuffled and one document is the largest thing a task holds.

Nulls and odd input: a null text counts like an empty one: all counts are 0 and the document fails. Repeated rows are
judged one by one. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"()'"
WINDOW = 8
#: Frequent short words of the four languages of the corpus, as plain fixed values.
STOP_WORDS = tuple(
    "the of and to in that it with was for is are on as by this "
    "der die und das den von mit nicht ist ein eine im zu dem auf sich "
    "de la le les et des que un une du en pour dans par sur au "
    "el los y del con para una se las por su es".split()
)
#: The base rules: fewest words, most percent of words in repeated windows.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: (name, count, per count, at least percent, at most percent); None: no bound.
RULES: list[tuple[str, str, str, int | None, int | None]] = [
    ("word length", "word_chars", "n_words", 200, 2000),
    ("symbols", "n_symbols", "n_words", None, 10),
    ("stop words", "n_stop_words", "n_words", 2, None),
    ("repeated lines", "n_dup_lines", "n_lines", None, 50),
    ("longest word", "longest_word", "word_chars", None, 50),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WORD_GAP = r"[\x20\x09-\x0D]+"


def _covered(positions: Column) -> Column:
    """Words covered by windows at ascending positions."""
    steps = F.transform(positions, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(positions, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, step: total + step)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and all counts. Each select uses the arrays before it at least twice, which keeps Spark from inlining them."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    plain = F.split(F.translate(F.lower(text), PUNCTUATION, " " * len(PUNCTUATION)), WORD_GAP)
    first = docs.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter(plain, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    counts = ["doc_id", "word_chars", "n_symbols", "n_stop_words"]
    n = F.size("words")
    hashed = first.select(
        *counts,
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).cast("long").alias("longest_word"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    counts += ["n_words", "n_lines", "n_dup_lines", "longest_word"]
    none = F.size("windows") == F.size(F.array_distinct("windows"))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.select(*counts, F.when(none, F.lit(None)).otherwise(pairs).alias("ordered"))
    same = lambda k, x: F.coalesce(F.get("ordered", k)["h"] == x["h"], F.lit(False))
    found = ordered.select(
        *counts,
        F.when(F.col("ordered").isNotNull(), F.sort_array(F.transform(F.filter("ordered", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))).alias("at"),
    )
    return found.select(*counts, F.coalesce(_covered(F.col("at")), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def verdict(rules: list[tuple[str, str, str, int | None, int | None]] = RULES) -> Column:
    """True where every bound of the table holds."""
    held = F.lit(True)
    for _, count, per, least, most in rules:
        if least is not None:
            held = held & (100 * F.col(count) >= least * F.col(per))
        if most is not None:
            held = held & (100 * F.col(count) <= most * F.col(per))
    return held


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measures(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


def _rules_sql() -> str:
    bounds = [f"100 * {c} >= {a} * {p}" for _, c, p, a, _ in RULES if a is not None] + [f"100 * {c} <= {b} * {p}" for _, c, p, _, b in RULES if b is not None]
    return " AND ".join(bounds)


OP3_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    regexp_split_to_array(regexp_replace(lower(t), '[.,;:!?"()'']', ' ', 'g'), '[\\x20\\x09-\\x0D]+') AS plain
  FROM texts),
counts AS (
  SELECT doc_id, words,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(plain, lambda x: x IN ({', '.join(f"'{w}'" for w in STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest_word
  FROM parts),
windows AS (SELECT doc_id, i, words[i:i + 7] AS w FROM counts, unnest(range(1, n_words - 6)) AS u(i) WHERE n_words >= 8),
found AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
steps AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM found),
covered AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n FROM steps GROUP BY doc_id),
all_counts AS (SELECT counts.*, coalesce(n, 0) AS n_repeat_words FROM counts LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < {FEWEST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM all_counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_rules_sql()} AS kept
FROM judged
"""
