"""Profiles as mutations(individual, gene, value); zeros aren't stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carrier_profile(carriers: DataFrame) -> DataFrame:
    """Scores of carriers(gene, individual, score) summed by cell; zero sums aren't stored."""
    return carriers.groupBy("individual", "gene").agg(F.sum("score").alias("value")).filter("value <> 0")


def merge_profiles_max(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cell by cell the larger value of two profiles, a missing cell being 0."""
    cells = first.select("individual", "gene", "value").unionByName(second.select("individual", "gene", "value"))
    found = cells.groupBy("individual", "gene").agg(F.max("value").alias("value"), F.count("*").alias("_n"))
    return found.select("individual", "gene", F.when(F.col("_n") > 1, F.col("value")).otherwise(F.greatest("value", F.lit(0.0))).alias("value")).filter("value <> 0")


def mutation_burden(mut: DataFrame) -> DataFrame:
    return mut.groupBy("individual").agg(F.sum("value").alias("burden"))


def burden_histogram(burdens: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, low, high, n, density) of burdens(individual, burden): equal bins over min..max, the last one closed.

    A single value gets one bin of width 1 around it.
    """
    span = burdens.agg(F.min("burden").alias("lo"), F.max("burden").alias("hi"), F.count("burden").alias("total")).filter("total > 0")
    span = span.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "total")
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor((F.col("burden") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = burdens.filter("burden is not null").join(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    frame = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    n = F.coalesce("n", F.lit(0))
    return frame.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * step).alias("low"), (F.col("lo") + (F.col("bin") + 1) * step).alias("high"), n.alias("n"), (n / (F.col("total") * step)).alias("density"))


def burden_kde(burdens: DataFrame, bandwidth: float = 0.2, points: int = 1000) -> DataFrame:
    """(point, x, density): Gaussian kernels on a grid from 1 to the largest burden; kernel sd is bandwidth * sample sd.

    Burdens are counted first; each point then sums over distinct values, which are few against individuals.
    """
    stats = burdens.agg(F.max("burden").alias("top"), F.stddev_samp("burden").alias("sd"), F.count("burden").alias("total")).filter("sd > 0")
    grid = stats.select("*", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: 1 + i * (F.col("top") - 1) / (points - 1))).alias("point", "x"))
    counts = burdens.filter("burden is not null").groupBy("burden").agg(F.count("*").alias("n"))
    width = F.col("sd") * bandwidth
    kernel = F.exp(-F.pow((F.col("x") - F.col("burden")) / width, 2) / 2) / (width * F.sqrt(F.lit(2 * 3.141592653589793)))
    return counts.join(F.broadcast(grid)).groupBy("point", "x").agg((F.sum(F.col("n") * kernel) / F.max("total")).alias("density"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_null, share_null) in one pass."""
    n = F.count(F.lit(1))
    sums = [F.struct(F.lit(c).alias("column"), F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias("n_null"), n.alias("n")) for c in df.columns]
    return df.agg(F.array(*sums).alias("a")).select(F.explode("a").alias("r")).select("r.column", "r.n_null", F.when(F.col("r.n") > 0, F.col("r.n_null") / F.col("r.n")).alias("share_null"))


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_duplicated_keys, n_rows_in_duplicated)."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counts.agg(zero(F.sum("n")).alias("n_rows"), F.count("*").alias("n_keys"), zero(F.sum((F.col("n") > 1).cast("long"))).alias("n_duplicated_keys"), zero(F.sum(F.when(F.col("n") > 1, F.col("n")))).alias("n_rows_in_duplicated"))


def distinct_endpoints(df: DataFrame, a: str, b: str, approximate: bool = False) -> DataFrame:
    from .mapping import endpoints

    count = F.approx_count_distinct("gene") if approximate else F.count_distinct("gene")
    return endpoints(df, a, b).agg(count.alias("n_ids"))


def hoyer_sparseness(vectors: DataFrame, key: str, n: int) -> DataFrame:
    """(key, sparseness) of stored cells (key, value) of vectors with n places, zeros among them; null for a zero vector."""
    l1, l2, root = F.sum(F.abs("value")), F.sqrt(F.sum(F.col("value") * F.col("value"))), F.sqrt(F.lit(float(n)))
    return vectors.groupBy(key).agg(F.when(l2 > 0, (root - l1 / l2) / (root - 1)).alias("sparseness"))
