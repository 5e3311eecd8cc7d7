"""The driver tables in the roles of the domain, and the same roles as SQL.

individual: supplier, customer or nation; gene: part; interaction: two parts in one order, scored by their quantities.
An order has a few lines, so pairs within orders grow with the orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, score): part pairs a < b."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    other = lines.toDF("l_orderkey", "p2", "q2")
    return lines.join(other, "l_orderkey").filter("l_partkey < p2").groupBy(F.col("l_partkey").alias("a"), F.col("p2").alias("b")).agg(F.sum(F.col("l_quantity") + F.col("q2")).alias("score"))


LINKS = """links AS (
  SELECT x.l_partkey AS a, y.l_partkey AS b, sum(x.l_quantity + y.l_quantity) AS score
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2)"""


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts of two lines of one order, as they come: repeated, in either order, loops among them."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"), F.col("l_linenumber").alias("i"))
    return lines.join(lines.toDF("l_orderkey", "b", "j"), "l_orderkey").filter("i < j").select("a", "b")


RAW_PAIRS = "raw_pairs AS (SELECT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber)"


def edges(spark: SparkSession, sf_dir: str, share: float = 0.3) -> DataFrame:
    """The symmetric 0/1 network of the strongest links of parts."""
    from ..operators.clean import top_fraction
    from ..operators.network import binary_adjacency

    # counted and then searched: the pairs are made once
    return binary_adjacency(top_fraction(materialise(links(spark, sf_dir), "links"), "score", share, ["a", "b"]), "a", "b")


def edges_sql(share: float = 0.3) -> str:
    return (
        LINKS
        + f""",
ranked_links AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS r, count(*) OVER () AS total FROM links),
top_links AS (SELECT a, b FROM ranked_links WHERE r <= round_even(total * {share}::DOUBLE, 0)),
edges AS (SELECT a AS src, b AS dst, 1.0::DOUBLE AS weight FROM top_links UNION ALL SELECT b, a, 1.0::DOUBLE FROM top_links)"""
    )


EDGES = edges_sql()


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(individual, gene, value): number of lines of each supplier and part."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("individual"), F.col("l_partkey").alias("gene")).agg(F.count("*").cast("double").alias("value"))


PROFILE = "profile AS (SELECT l_suppkey AS individual, l_partkey AS gene, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"


def nation_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(individual, gene, value): number of lines of each supplier nation and part; few individuals, all genes."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("gene"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("individual"))
    return lines.join(own, "l_suppkey").groupBy("individual", "gene").agg(F.count("*").cast("double").alias("value"))


NATION_PROFILE = "profile AS (SELECT s_nationkey AS individual, l_partkey AS gene, CAST(count(*) AS DOUBLE) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("individual"))


INDIVIDUALS = "individuals AS (SELECT s_suppkey AS individual FROM supplier)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as clustered individuals: cluster = balance class 0..3, role by segment, sex by nation, measures by orders."""
    customers = table(spark, sf_dir, "customer")
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("burden"))
    cluster = F.least(F.floor((F.col("c_acctbal") + 1000) / 2750), F.lit(3)).cast("int")
    own = customers.select(
        F.col("c_custkey"),
        cluster.alias("cluster"),
        F.when(F.col("c_mktsegment") == "BUILDING", "sibling").when(F.col("c_mktsegment") == "MACHINERY", "proband").alias("role"),
        F.when(F.col("c_nationkey") < 12, "female").otherwise("male").alias("sex"),
        F.when(F.col("c_nationkey") != 7, F.col("c_acctbal")).alias("iq"),
        F.length("c_mktsegment").cast("double").alias("srs"),
        F.col("c_nationkey").cast("double").alias("vineland"),
        (F.col("c_acctbal") * F.col("c_nationkey")).alias("distance"),
    )
    return own.join(spent, "c_custkey", "left").withColumnRenamed("c_custkey", "individual")


MEMBERS = """members AS (
  SELECT c_custkey AS individual, CAST(least(floor((c_acctbal + 1000) / 2750), 3) AS INTEGER) AS cluster,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'sibling' WHEN 'MACHINERY' THEN 'proband' END AS role,
    CASE WHEN c_nationkey < 12 THEN 'female' ELSE 'male' END AS sex,
    CASE WHEN c_nationkey <> 7 THEN c_acctbal END AS iq, CAST(length(c_mktsegment) AS DOUBLE) AS srs,
    CAST(c_nationkey AS DOUBLE) AS vineland, c_acctbal * c_nationkey AS distance, burden
  FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS burden FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""

def supplier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with role, sex and measures, for what describes clusters of them."""
    own = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("individual"),
        F.when(F.col("s_nationkey") % 3 == 0, "sibling").when(F.col("s_nationkey") % 3 == 1, "proband").alias("role"),
        F.when(F.col("s_nationkey") < 12, "female").otherwise("male").alias("sex"),
        F.col("s_acctbal").alias("iq"),
        F.col("s_nationkey").cast("double").alias("srs"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("individual"))
    sold = lines.agg(F.avg("l_quantity").alias("vineland"), F.avg("l_discount").alias("distance"), F.count("*").cast("double").alias("burden"))
    return own.join(sold, "individual", "left")


REPLICATES = 12


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(replicate, id, cluster) of suppliers: each in 80 % of replicates, labels 0..2 that mostly follow the nation."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("replicate"))
    draw = lambda tag, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(tag), "replicate", "id").cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(n))
    cluster = F.when(draw("noise", 5) == 0, draw("other", 3)).otherwise(F.col("s_nationkey") % 3).cast("int")
    return rows.filter(draw("sampled", 5) != 0).select("replicate", "id", cluster.alias("cluster"))


def _draw_sql(tag: str, n: int) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{tag}', replicate, s_suppkey)), 1, 7) AS BIGINT) % {n})"


LABELS = f"""labels AS (
  SELECT CAST(replicate AS INTEGER) AS replicate, s_suppkey AS id,
    CAST(CASE WHEN {_draw_sql('noise', 5)} = 0 THEN {_draw_sql('other', 3)} ELSE s_nationkey % 3 END AS INTEGER) AS cluster
  FROM supplier, range({REPLICATES}) AS r(replicate) WHERE {_draw_sql('sampled', 5)} <> 0)"""
