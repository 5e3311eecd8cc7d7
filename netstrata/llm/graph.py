"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rounds grow with the logarithm of the largest component; more than this means an error.
MOST_ROUNDS = 60
#: Tasks that the larger neighbours of one node are dealt over.
SALTS = 16


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to its smallest one. The neighbours of a hot node are dealt by salts, of which every
    node that has larger neighbours, few once stars have formed, gets a copy."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.max("b").alias("top")).filter("top > a")
    copies = least.select("a", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    larger = both.filter("b > a").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return larger.join(copies, ["a", "salt"]).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a long, b long); component is the smallest node that can be reached.

    Loops and repeated edges are allowed. Only (node, smallest neighbour) pairs are kept between rounds; each round is
    written to the shared folder. An empty table gives no rows.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = materialise(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
