"""Networks as edges(src, dst, weight) in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mapping import endpoints


def network_genes(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    return endpoints(pairs, a, b).distinct()


def _both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst")))).alias("e")).select("e.src", "e.dst")


def binary_adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Symmetric 0/1 adjacency; repeats collapse, loops stay."""
    return _both_ways(pairs, a, b).distinct().withColumn("weight", F.lit(1.0))


def count_adjacency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Symmetric adjacency that counts repeats, in either order; no loops."""
    return _both_ways(pairs.filter(F.col(a) != F.col(b)), a, b).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def gene_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("gene")).agg(F.sum("weight").alias("degree"))


def degree_distribution(edges: DataFrame) -> DataFrame:
    return gene_degree(edges).groupBy("degree").agg(F.count("*").alias("n_genes"))


def align_genes(edges: DataFrame, mut: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genes, edges, profile): the joint universe with degrees, and both tables without genes of degree 0."""
    from .mapping import classify_genes

    degree = gene_degree(edges)
    genes = classify_genes(network_genes(edges), mut.select("gene")).join(degree, "gene", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    connected = genes.filter("degree > 0").select("gene")
    kept = edges.join(connected.withColumnRenamed("gene", "src"), "src", "left_semi").join(connected.withColumnRenamed("gene", "dst"), "dst", "left_semi")
    return genes, kept.select("src", "dst", "weight"), mut.join(connected, "gene", "left_semi")


def final_profile(mut: DataFrame, genes: DataFrame, keep_singletons: bool) -> DataFrame:
    """The profile over all genes, or over genes(gene, degree) with a neighbour."""
    return mut if keep_singletons else mut.join(genes.filter("degree > 0").select("gene"), "gene", "left_semi")


def symmetrize(matrix: DataFrame, how: str) -> DataFrame:
    """min or max of a_ij and a_ji for both; absent cells count as 0, and results of 0 aren't stored."""
    pair = matrix.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    both = pair.agg(F.max("value").alias("hi"), F.min("value").alias("lo"), F.count("*").alias("n"))
    value = F.when(F.col("n") == 2, F.col("lo")).otherwise(F.least("lo", F.lit(0.0))) if how == "min" else F.when(F.col("n") == 2, F.col("hi")).otherwise(F.greatest("hi", F.lit(0.0)))
    cells = both.select("a", "b", value.alias("value")).filter("value <> 0")
    mirrored = cells.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), "value")
    return mirrored.select("e.src", "e.dst", "value").union(matrix.filter("src = dst").select("src", "dst", "value"))


def best_neighbours(edges: DataFrame, influence: DataFrame, n: int = 11) -> DataFrame:
    """Network edges among each gene's n + 1 largest influences (itself among them), kept if either end chose them.

    Ties go to the gene that sorts first.
    """
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "dst"))
    chosen = influence.withColumn("_r", rank).filter(F.col("_r") <= n + 1).select("src", "dst")
    kept = edges.join(chosen, ["src", "dst"], "left_semi")
    return kept.union(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
