"""Descriptions of clusters: members, counts, ratios, medians, comparisons of labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scratch import materialise
from .running import beside, running_sums

COUNTS = ["n_total", "n_sibling", "n_proband", "n_female", "n_male"]
MEASURES = ["iq", "srs", "vineland", "distance", "burden"]


def cluster_genes(clusters: DataFrame, genes: DataFrame) -> DataFrame:
    """(cluster, gene id) by key: clusters(id, cluster), genes(id, gene)."""
    return clusters.join(genes, "id").select("cluster", "gene")


def attach_phenotypes(clusters: DataFrame, phenotypes: DataFrame, distances: DataFrame, burdens: DataFrame) -> DataFrame:
    """Clustered individuals with phenotype, ancestry distance and burden; missing ones are null."""
    found = clusters.join(phenotypes, "individual", "left").join(distances, "individual", "left")
    return found.join(burdens, "individual", "left")


def compare_cohorts(results: DataFrame, a: str, b: str, on: str | list[str] = "k") -> DataFrame:
    """Rows of cohorts a and b side by side, columns with suffixes 1 and 2, in order of the keys."""
    keys = [on] if isinstance(on, str) else on
    own = lambda name, s: results.filter(F.col("cohort") == name).select(*keys, *(F.col(c).alias(f"{c}{s}") for c in results.columns if c not in (*keys, "cohort")))
    return own(a, "1").join(own(b, "2"), keys).orderBy(*keys)


def cluster_counts(members: DataFrame, keys: list[str]) -> DataFrame:
    """Total, siblings, probands, females and males of members(..., role, sex)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return members.groupBy(*keys).agg(F.count("*").alias("n_total"), n(F.col("role") == "sibling")("n_sibling"), n(F.col("role") == "proband")("n_proband"), n(F.col("sex") == "female")("n_female"), n(F.col("sex") == "male")("n_male"))


def cluster_ratios(counts: DataFrame, run: list[str]) -> DataFrame:
    """Add each count over its cluster's total (_in_cluster) and over the count of all clusters of the run (_of_all)."""
    whole = Window.partitionBy(*run)
    parts = {f"{c}_in_cluster": F.col(c) / F.nullif("n_total", F.lit(0)) for c in COUNTS[1:]}
    return counts.withColumns(parts | {f"{c}_of_all": F.col(c) / F.nullif(F.sum(c).over(whole), F.lit(0)) for c in COUNTS})


def cluster_medians(members: DataFrame, keys: list[str], measures: list[str] = MEASURES) -> DataFrame:
    """(keys, median_<measure>): nulls don't count; null without values. Values are counted first, and running counts over
    ranges of the distinct values (running.py) find the middle ones, so no task holds a cluster's values."""
    long = members.unpivot(keys, [F.col(c).cast("double").alias(c) for c in measures], "_measure", "_value")
    counts = long.groupBy(*keys, "_measure", "_value").agg(F.count("_value").alias("_n"))
    counts, own = counts.filter("_n > 0"), [*keys, "_measure"]
    running = running_sums(counts, own, "_value", ["_n"]).withColumnRenamed("_upto__n", "_upto")
    running = beside(running, counts.groupBy(*own).agg(F.sum("_n").alias("_total")), own)
    at = lambda place: F.max(F.when((F.col("_upto") - F.col("_n") < place) & (place <= F.col("_upto")), F.col("_value")))
    low, high = (F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1)
    middle = running.groupBy(*keys, "_measure").agg(((at(low) + at(high)) / 2).alias("_median"))
    known = members.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("_measure"), F.lit(None).cast("double").alias("_median"))
    return middle.union(known).groupBy(*keys).agg(*(F.max(F.when(F.col("_measure") == c, F.col("_median"))).alias(f"median_{c}") for c in measures))


def component_composition(labels: DataFrame, category: str) -> DataFrame:
    """(category, component, percent): of each category's members, to one decimal, zero cells shown."""
    frame = labels.select(category).distinct().crossJoin(labels.select("component").distinct())
    counts = labels.groupBy(category, "component").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    share = n / F.sum(n).over(Window.partitionBy(category))
    return frame.join(counts, [category, "component"], "left").select(category, "component", (F.bround(1000 * share) / 10).alias("percent"))


def component_table(factors: DataFrame) -> DataFrame:
    """(id, weights, total, component): sum and place (from 0) of the largest weight."""
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return factors.select("id", "weights", total.alias("total"), argmax("weights").alias("component"))


def argmax(column: str):
    """Place from 0 of the largest item, the first on ties."""
    return (F.array_position(F.col(column), F.array_max(column)) - 1).cast("int")


def argmax_label(factors: DataFrame) -> DataFrame:
    """(id, label): place of the largest weight; with one component the weight itself."""
    own = F.when(F.size("weights") == 1, F.col("weights")[0]).otherwise(argmax("weights").cast("double"))
    return factors.select("id", own.alias("label"))


def component_genes(factors: DataFrame, min_weight: float = 0.1) -> DataFrame:
    return component_table(factors).filter(F.array_max("weights") > min_weight)


def confusion_matrix(a: DataFrame, b: DataFrame, normalize: bool = False) -> DataFrame:
    """(label_a, label_b, n) of a(id, label) and b(id, label), zero cells shown; normalize: share of the row, 2 decimals."""
    both = a.select("id", F.col("label").alias("label_a")).join(b.select("id", F.col("label").alias("label_b")), "id")
    counts = both.groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
    frame = counts.select("label_a").distinct().crossJoin(counts.select("label_b").distinct())
    found = frame.join(counts, ["label_a", "label_b"], "left").select("label_a", "label_b", F.coalesce("n", F.lit(0)).alias("n"))
    if not normalize:
        return found
    return found.select("label_a", "label_b", F.bround(F.col("n") / F.sum("n").over(Window.partitionBy("label_a")), 2).alias("share"))


def align_labels(a: DataFrame, b: DataFrame, shift: int = 0) -> DataFrame:
    """(label_a, label_b + shift) pairs by largest overlap first; ties by label_a, label_b. Labels left over aren't paired."""
    left = materialise(confusion_matrix(a, b), "overlap")
    picked = None
    while True:
        top = left.orderBy(F.desc("n"), "label_a", "label_b").limit(1).collect()  # one cell of a k x k table
        if not top:
            break
        x, y = top[0]["label_a"], top[0]["label_b"]
        one = left.filter((F.col("label_a") == x) & (F.col("label_b") == y)).select("label_a", (F.col("label_b") + shift).alias("label_b"))
        picked = one if picked is None else picked.union(one)
        left = left.filter((F.col("label_a") != x) & (F.col("label_b") != y))
    return picked if picked is not None else left.select("label_a", "label_b")
