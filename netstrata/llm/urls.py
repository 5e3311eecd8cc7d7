"""URL filter: rules first, then the ratio of two variable-order Markov models of characters.

A rule is a host and a path prefix and fits the host and its subdomains; the longest rule wins. URLs that rules allow or
block train two Witten-Bell smoothed models with contexts of up to ``ORDER - 1`` characters; a context that a model has seen
less than ``FEWEST`` times is left to its shorter ones, so the order used varies with what is known. All other URLs get the
difference of the models' log likelihoods for each character, over the host and all that follows it; the threshold is
calibrated by cross-fitting: hosts are dealt to ``FOLDS`` folds, ruled URLs of each are scored by models of the other folds,
and at most ``MOST_LOST`` of all allowed ones may score below the threshold (see calibrate). The models that judge learn from all ruled URLs.
``report`` says what the threshold loses and catches among them.

Nulls and odd input: a null URL, or one without ``://``, has empty host and path, fits no rule and is allowed. Without
URLs of both kinds to learn from, everything without a rule is allowed. Repeated rows are judged alike. Very long URLs take
memory in proportion in the task that scores them. An empty table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charmodel import Model, count_units, witten_bell
from .common import materialise, slices, table
from .langid import _counts, _Held

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
ORDER = 6
FEWEST = 2
MOST_LOST = 0.02
FOLDS = 3
#: Width and number of the buckets in which scores are counted for calibration.
STEP, BUCKETS = 0.02, 400


def host(url: str = "url") -> Column:
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: str = "url") -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, unit (what the models read: the host and all after it), rule and ruling (nulls where no rule fits)."""
    rest = F.coalesce(F.regexp_extract(F.col("url"), r"(?s)^.*?://[^/?#]*(.*)$", 1), F.lit(""))
    parts = pages.select("page_id", host().alias("host"), path().alias("path"), rest.alias("unit"))
    parts = parts.withColumn("unit", F.concat("host", "unit"))
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, name, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(F.col("path"), F.lit(prefix))
        rule, ruling = F.when(fits, F.lit(name + prefix)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruling)
    return parts.withColumns({"rule": rule, "ruling": ruling})


def _fold() -> Column:
    return F.crc32(F.col("host").cast("binary")) % FOLDS


def train(found: DataFrame, order: int = ORDER) -> Model | None:
    """The two models from ruled URLs; None unless both kinds are there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(counter: Counter, batch: pa.RecordBatch) -> None:
            units = Counter(zip(batch.column("ruling").to_pylist(), batch.column("unit").to_pylist(), strict=True))
            for (label, gram), n in count_units(units, order).items():
                counter[label, gram] += n

        return _counts(batches, add, ["label", "gram", "n"])

    known = found.filter(F.col("ruling").isNotNull()).select("ruling", "unit")
    grams = known.mapInArrow(count, "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    grams = materialise(grams, "gram-counts")
    labels = sorted(r["label"] for r in grams.select("label").distinct().collect())
    return witten_bell(grams, order, labels, FEWEST) if labels == ["allow", "block"] else None


def log_ratio(found: DataFrame, model: Model) -> DataFrame:
    """Add ratio: mean log likelihood of a character under the allowed model less that under the blocked one."""
    held, names = _Held(found.sparkSession, model), found.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            sums, sizes = held.value.score(batch.column("unit").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((sums[:, 0] - sums[:, 1]) / sizes)], [*names, "ratio"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return found.mapInArrow(score, f"{fields}, ratio double")


def cross_scored(found: DataFrame) -> DataFrame:
    """(ruling, ratio) of ruled URLs, each by models that haven't seen its host; folds whose rest lacks a kind are left out."""
    ruled_ones, parts = found.filter(F.col("ruling").isNotNull()), []
    for f in range(FOLDS):
        model = train(ruled_ones.filter(_fold() != f))
        if model is not None:
            parts.append(log_ratio(ruled_ones.filter(_fold() == f), model).select("ruling", "ratio"))
    whole = reduce(DataFrame.union, parts) if parts else ruled_ones.select("ruling", F.lit(None).cast("double").alias("ratio")).limit(0)
    return materialise(whole, "cross-scored")


def calibrate(scored: DataFrame, most_lost: float = MOST_LOST) -> float:
    """The threshold from scored(ruling, ratio), counted in buckets: the highest edge below which at most most_lost of the
    allowed URLs lie. Where the kinds lie farther apart than that, nearly all blocked ones below an edge still lower, it is
    the middle between both edges, as far from one kind as from the other. 0 without allowed URLs."""
    bucket = F.least(F.greatest(F.floor(F.col("ratio") / STEP), F.lit(-BUCKETS)), F.lit(BUCKETS))
    rows = scored.groupBy("ruling", bucket.alias("b")).count().collect()

    def reached(kind: str, down: bool) -> int | None:
        """The bucket at which more than most_lost of a kind have been passed, from below or from above."""
        own = sorted(((r["b"], r["count"]) for r in rows if r["ruling"] == kind), reverse=down)
        passed, total = 0, sum(n for _, n in own)
        for b, n in own:
            passed += n
            if passed > most_lost * total:
                return b
        return None

    allowed, blocked = reached("allow", False), reached("block", True)
    if allowed is None:
        return 0.0
    return float(allowed if blocked is None or blocked + 1 >= allowed else (allowed + blocked + 1) / 2) * STEP


def report(scored: DataFrame, limit: float) -> DataFrame:
    """(ruling, n, n_below): of scored(ruling, ratio), how many of each kind score below the limit."""
    return scored.groupBy("ruling").agg(F.count("*").alias("n"), F.sum((F.col("ratio") < limit).cast("long")).alias("n_below"))


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (null where the models don't decide)."""
    found = ruled(pages)
    model = train(found)
    if model is None:
        return found.select("page_id", "host", "path", "rule", F.coalesce("ruling", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    limit = calibrate(cross_scored(found))
    scored = log_ratio(found, model)
    method = F.when((F.col("ratio") < limit) & (F.col("host") != ""), "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), F.when(F.col("ruling").isNull(), F.col("ratio")).alias("ratio"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
