"""Joins of pairs and profiles with id mappings. Mapping sides are broadcast by Spark's own size check, if at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_pair_ids(pairs: DataFrame, mapping: DataFrame, a: str, b: str, key: str, value: str, out: tuple[str, str]) -> DataFrame:
    """Left join each endpoint onto mapping(key, value); unmapped endpoints get null."""
    for end, name in zip((a, b), out, strict=True):
        side = mapping.select(F.col(key).alias("_key"), F.col(value).alias(name))
        pairs = pairs.join(side, F.col(end) == F.col("_key"), "left").drop("_key")
    return pairs


def map_with_fallback(pairs: DataFrame, symbol: str, second: str, primary: DataFrame, secondary: DataFrame, out: str) -> DataFrame:
    """primary(symbol, id) by the symbol; only where the symbol is null, secondary(key, id) by the second column."""
    first = primary.select(F.col(primary.columns[0]).alias("_k1"), F.col(primary.columns[1]).alias("_id1"))
    other = secondary.select(F.col(secondary.columns[0]).alias("_k2"), F.col(secondary.columns[1]).alias("_id2"))
    joined = pairs.join(first, F.col(symbol) == F.col("_k1"), "left").join(other, F.col(second) == F.col("_k2"), "left")
    return joined.withColumn(out, F.when(F.col(symbol).isNull(), F.col("_id2")).otherwise(F.col("_id1"))).drop("_k1", "_k2", "_id1", "_id2")


def endpoints(pairs: DataFrame, a: str, b: str, out: str = "gene") -> DataFrame:
    return pairs.select(F.col(a).alias(out)).union(pairs.select(F.col(b).alias(out)))


def unmapped_symbols(pairs: DataFrame, a: str, b: str, mapping: DataFrame, key: str) -> DataFrame:
    """Distinct endpoint symbols without a mapping."""
    return endpoints(pairs, a, b, key).dropna().distinct().join(mapping.select(key), key, "left_anti")


def unmapped_report(pairs: DataFrame, a: str, b: str, mapping: DataFrame, key: str) -> DataFrame:
    """(n_symbols, n_unmapped, share_unmapped)."""
    known = mapping.select(key).dropna().distinct().withColumn("_known", F.lit(1))
    n, lost = F.count(F.lit(1)), F.coalesce(F.sum(F.col("_known").isNull().cast("long")), F.lit(0))
    return endpoints(pairs, a, b, key).dropna().distinct().join(known, key, "left").agg(n.alias("n_symbols"), lost.alias("n_unmapped"), F.when(n > 0, lost / n).alias("share_unmapped"))


def map_profile_genes(profile: DataFrame, mapping: DataFrame, symbol: str) -> DataFrame:
    """Outer merge on the symbol, then complete rows alone: the same rows as an inner join of complete tables."""
    return profile.dropna().join(mapping.dropna(), symbol, "inner")


def classify_genes(net_genes: DataFrame, mut_genes: DataFrame) -> DataFrame:
    """(gene, gene_class): common, network_only or mutation_only."""
    net, mut = net_genes.select("gene").distinct().withColumn("_n", F.lit(1)), mut_genes.select("gene").distinct().withColumn("_m", F.lit(1))
    kind = F.when(F.col("_m").isNull(), "network_only").when(F.col("_n").isNull(), "mutation_only").otherwise("common")
    return net.join(mut, "gene", "full_outer").select("gene", kind.alias("gene_class"))


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n_a, n_b, n_both, share_a, share_b) over distinct ids."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    n_a, n_b = count(F.col("_a").isNotNull()), count(F.col("_b").isNotNull())
    n = count(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(n_a.alias("n_a"), n_b.alias("n_b"), n.alias("n_both"), F.when(n_a > 0, n / n_a).alias("share_a"), F.when(n_b > 0, n / n_b).alias("share_b"))
