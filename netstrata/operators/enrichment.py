"""Term enrichment of clusters of genes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialise
from ..functions.tails import log_factorial, normal_quantile
from .clusters import compare_cohorts
from .stats import adjust_bh


def propagate_annotations(gene_terms: DataFrame, term_parents: DataFrame) -> DataFrame:
    """(gene, term): each gene's terms and all their ancestors; the closure of terms is made once, level by level."""
    up = term_parents.filter("parent is not null").select("term", "parent").distinct()
    now = materialise(up.select("term", F.col("parent").alias("ancestor")), "closure")
    whole = now
    while True:
        step = now.join(up.select(F.col("term").alias("ancestor"), "parent"), "ancestor").select("term", F.col("parent").alias("ancestor")).distinct()
        now = materialise(step.join(whole, ["term", "ancestor"], "left_anti"), "closure")
        if not now.limit(1).count():
            break
        whole = whole.union(now)
    above = gene_terms.join(whole, "term").select("gene", F.col("ancestor").alias("term"))
    return gene_terms.select("gene", "term").union(above).distinct()


def enrich(cluster_genes: DataFrame, annotations: DataFrame, terms: DataFrame, keys: list[str], min_size: int = 2, max_size: int = 500, max_depth: int | None = None) -> DataFrame:
    """(keys, term, namespace, x, n, n_query, n_background, p, q): hypergeometric upper tail of hits x of n annotated, with
    n_query genes asked for and n_background in all.

    cluster_genes(keys, gene), annotations(gene, term) distinct, terms(term, namespace, depth). Genes without annotation
    don't count. q is by cluster. The tail is summed over rows i = x .. min(n, n_query) of each (cluster, term).
    """
    background = annotations.select("gene").distinct()
    m = background.agg(F.count("*").alias("n_background"))
    sizes = annotations.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n").between(min_size, max_size))
    chosen = sizes.join(terms.select("term", "namespace", "depth"), "term")
    if max_depth is not None:
        chosen = chosen.filter(F.col("depth") <= max_depth)
    asked = cluster_genes.select(*keys, "gene").distinct().join(background, "gene", "left_semi")
    query = asked.groupBy(*keys).agg(F.count("*").alias("n_query"))
    hits = asked.join(annotations, "gene").groupBy(*keys, "term").agg(F.count("*").alias("x"))
    rows = hits.join(chosen, "term").join(query, keys).join(F.broadcast(m))
    tail = rows.withColumn("i", F.explode(F.sequence(F.col("x"), F.least("n", "n_query"))))
    lf = lambda c: log_factorial(c.cast("double"))
    i, n, q, whole = (F.col(c) for c in ("i", "n", "n_query", "n_background"))
    possible = (q - i) <= (whole - n)
    log_p = lf(n) - lf(i) - lf(n - i) + lf(whole - n) - lf(q - i) - lf(F.greatest(whole - n - q + i, F.lit(0))) - (lf(whole) - lf(q) - lf(whole - q))
    own = [*keys, "term", "namespace", "depth", "x", "n", "n_query", "n_background"]
    found = tail.groupBy(*own).agg(F.least(F.lit(1.0), F.sum(F.when(possible, F.exp(log_p)).otherwise(0.0))).alias("p"))
    return adjust_bh(found.filter("p is not null"), "p", keys)


def enrichment_scores(found: DataFrame) -> DataFrame:
    """Rows with p < 0.05 and lod = (x/n) / (n_query/n_background - n_query), z = normal quantile of p, score = -ln p; nulls where undefined."""
    rows = found.filter("p < 0.05")
    lod = (F.col("x") / F.col("n")) / F.nullif(F.col("n_query") / F.col("n_background") - F.col("n_query"), F.lit(0.0))
    return rows.withColumns({"lod": lod, "z": normal_quantile("p"), "score": F.when(F.col("p") > 0, -F.log("p"))})


def term_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, namespace, n_terms, n_significant, ratio) for each cluster."""
    hit = F.sum((F.col("p") < 0.05).cast("long"))
    return found.groupBy(*keys, "namespace").agg(F.count("*").alias("n_terms"), hit.alias("n_significant"), F.when(F.count("*") > 0, hit / F.count("*")).otherwise(0.0).alias("ratio"))


def term_counts_by_k(counts: DataFrame, keys: list[str], namespaces: list[str]) -> DataFrame:
    """Over a run's clusters: sums of significant terms and largest ratios, columns for each namespace."""
    wide = counts.groupBy(*keys).pivot("namespace", namespaces).agg(F.sum("n_significant").alias("n"), F.max("ratio").alias("ratio"))
    return wide.fillna(0).select(*keys, *(F.col(f"`{s}_{c}`").cast("long" if c == "n" else "double").alias(f"{s}_{c}") for s in namespaces for c in ("n", "ratio")))


def enrichment_by_k(cluster_genes: DataFrame, annotations: DataFrame, terms: DataFrame, a: str, b: str, namespaces: list[str], **limits) -> DataFrame:
    """Both cohorts side by side by k: cluster_genes(cohort, k, cluster, gene), all runs as keys of one job."""
    found = enrich(cluster_genes, annotations, terms, ["cohort", "k", "cluster"], **limits)
    wide = term_counts_by_k(term_counts(found, ["cohort", "k", "cluster"]), ["cohort", "k"], namespaces)
    return compare_cohorts(wide, a, b)
