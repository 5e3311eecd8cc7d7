"""Filters and cleaning of interaction, mapping and profile tables. All are plain projections, filters or windows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialise

def filter_species(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
    """Rows whose endpoint names all contain the tag; null names don't."""
    return df.filter(reduce(and_, (F.col(c).contains(tag) for c in cols)))


def species_report(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
    """(n_before, n_after, share_removed) in one pass."""
    kept = F.sum(reduce(and_, (F.coalesce(F.col(c).contains(tag), F.lit(False)) for c in cols)).cast("long"))
    return _report(df, F.coalesce(kept, F.lit(0)))


def _report(df: DataFrame, kept) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_before"), kept.cast("long").alias("n_after"), F.when(n > 0, 1 - kept / n).alias("share_removed"))


def strip_prefix(df: DataFrame, cols: dict[str, str], prefix: str) -> DataFrame:
    """Rename columns and take a literal prefix off their values where it stands."""
    return df.withColumns({new: F.when(F.startswith(F.col(old), F.lit(prefix)), F.substr(F.col(old), F.lit(len(prefix) + 1))).otherwise(F.col(old)) for old, new in cols.items()}).drop(*(old for old, new in cols.items() if old != new))


def top_fraction(df: DataFrame, score: str, frac: float, tiebreak: list[str]) -> DataFrame:
    """The n = round-half-even(rows * frac) rows with the largest scores; ties by the tiebreak columns, ascending.

    Counts by score give the score at which the rows run out, so only rows of that one score are ranked, and only if
    they don't all fit. Integer-like scores have few values; the counts are a table of distinct scores, written once. The
    rows are read three times, so give a written table where they are dear to make.
    """
    counts = materialise(df.groupBy(score).agg(F.count("*").alias("_n")), "score-counts")
    total = counts.agg(F.bround(F.coalesce(F.sum("_n"), F.lit(0)) * F.lit(frac)).cast("long").alias("_want"))
    # running counts over ranges of scores: partial sums of 1024 slices, then within a slice
    edge = counts.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    slices = counts.join(F.broadcast(edge)).withColumn("_slice", F.when(F.col("_hi") > F.col("_lo"), F.floor(1023 * (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).otherwise(F.lit(0)))
    sums = slices.groupBy("_slice").agg(F.sum("_n").alias("_in"))
    above = sums.select("_slice", F.coalesce(F.sum("_in").over(Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    inside = Window.partitionBy("_slice").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    before = slices.join(F.broadcast(above), "_slice").select(score, "_n", (F.col("_above") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_before"))
    left = before.join(F.broadcast(total)).filter(F.col("_before") < F.col("_want")).select(F.col(score).alias("_score"), "_n", (F.col("_want") - F.col("_before")).alias("_left"))
    rows = df.join(left, df[score] == F.col("_score"))
    whole = rows.filter("_n <= _left").select(*df.columns)
    last = rows.filter("_n > _left").withColumn("_r", F.row_number().over(Window.partitionBy("_score").orderBy(*tiebreak))).filter("_r <= _left").select(*df.columns)
    return whole.union(last)


def drop_null_endpoints(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with all mapped ids, as long integers."""
    return df.dropna(subset=cols).withColumns({c: F.col(c).cast("long") for c in cols})


def null_endpoint_report(df: DataFrame, cols: list[str]) -> DataFrame:
    kept = F.sum(reduce(and_, (F.col(c).isNotNull() for c in cols)).cast("long"))
    return _report(df, F.coalesce(kept, F.lit(0)))


def drop_ambiguous(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands once; every row of a repeated key goes. Null keys count as one key."""
    single = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n = 1").select(F.col(key).alias("_key"))
    return df.join(single, df[key].eqNullSafe(F.col("_key")), "left_semi")


def dedupe_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.dropDuplicates([a, b])


def drop_self_interactions(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def clean_symbols(df: DataFrame, symbol: str, entrez: str) -> DataFrame:
    """Complete rows with a finite id whose symbol isn't withdrawn; ids become long."""
    kept = df.select(symbol, entrez).filter(~F.col(symbol).contains("withdrawn") & F.col(entrez).isNotNull() & ~F.isnan(entrez) & (F.abs(F.col(entrez)) != float("inf")))
    return kept.dropna().withColumn(entrez, F.col(entrez).cast("long"))


def validate_profile(mut: DataFrame) -> DataFrame:
    """The profile if values are numbers >= 0 and cells are unique; raises ValueError else. One aggregate each."""
    bad = mut.agg(F.sum((F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0)).cast("long"))).first()[0]
    twice = mut.groupBy("individual", "gene").count().filter("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError(f"{bad or 0} values are negative or missing; repeated cells: {bool(twice)}")
    return mut


def validate_network(edges: DataFrame) -> DataFrame:
    """The network if it is symmetric with a zero diagonal and unique cells; raises ValueError else."""
    cells = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.countDistinct("src").alias("ends"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    bad = cells.filter("a = b or n <> 2 or ends <> 2 or lo <> hi or lo < 0").limit(1).count()
    if bad:
        raise ValueError("the network has loops, repeated or one-sided edges, or negative weights")
    return edges


def burdens(mut: DataFrame, individuals: DataFrame) -> DataFrame:
    """(individual, burden) with 0 for individuals without a stored cell."""
    sums = mut.groupBy("individual").agg(F.sum("value").alias("burden"))
    return individuals.select("individual").join(sums, "individual", "left").select("individual", F.coalesce("burden", F.lit(0.0)).alias("burden"))


def filter_by_burden(mut: DataFrame, individuals: DataFrame, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """(profile, individuals) of those with lo <= row sum <= hi; empty profiles have 0."""
    kept = burdens(mut, individuals).filter(F.col("burden").between(lo, hi)).select("individual")
    return mut.join(kept, "individual", "left_semi"), kept


def subset_by(mut: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return mut.join(ids.select(key).distinct(), key, "left_semi")


def subset_individuals(mut: DataFrame, ids: DataFrame) -> DataFrame:
    return subset_by(mut, ids, "individual")


def subset_genes(mut: DataFrame, genes: DataFrame) -> DataFrame:
    return subset_by(mut, genes, "gene")


def subset_report(mut: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """(n_requested, n_kept, n_removed): ids asked for, of the profile's ids those kept and dropped."""
    asked, have = ids.select(key).distinct().withColumn("_asked", F.lit(1)), mut.select(key).distinct().withColumn("_have", F.lit(1))
    both = asked.join(have, key, "full_outer")
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, h = F.col("_asked").isNotNull(), F.col("_have").isNotNull()
    return both.agg(one(a).alias("n_requested"), one(a & h).alias("n_kept"), one(~a & h).alias("n_removed"))


def role_from_id(df: DataFrame, column: str) -> DataFrame:
    """Add role from the last but one character of an id: s sibling, p proband, else null."""
    mark = F.when(F.length(column) >= 2, F.substring(F.col(column), -2, 1))
    return df.withColumn("role", F.when(mark == "s", "sibling").when(mark == "p", "proband"))
