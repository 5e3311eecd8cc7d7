"""Tests on clusters. Statistics are aggregates and windows partitioned by run and measure; only tails are helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import chi2_p, ks_p
from .running import beside, running_sums


def round_keeping_sum(df: DataFrame, keys: list[str], expected: str, observed: str, order: str, out: str = "rounded") -> DataFrame:
    """Round expected half to even; the first largest element takes what is missing to the sum of observed."""
    own = Window.partitionBy(*keys)
    rounded = df.withColumn("_r", F.bround(expected))
    first = F.row_number().over(own.orderBy(F.desc("_r"), order))
    return rounded.withColumn(out, F.col("_r") + F.when(first == 1, F.sum(observed).over(own) - F.sum("_r").over(own)).otherwise(0.0)).drop("_r")


def chi2_counts(df: DataFrame, keys: list[str], observed: str, total: str, order: str) -> DataFrame:
    """(keys, statistic, df, p): are counts in proportion to cluster totals? Null where an expected count is 0."""
    own = Window.partitionBy(*keys)
    share = df.withColumn("_e", F.col(total) * F.sum(observed).over(own) / F.nullif(F.sum(total).over(own), F.lit(0)))
    ready = round_keeping_sum(share, keys, "_e", observed, order)
    term = F.pow(F.col(observed) - F.col("rounded"), 2) / F.nullif("rounded", F.lit(0.0))
    whole = ready.groupBy(*keys).agg(F.when(F.min("rounded") > 0, F.sum(term)).alias("statistic"), (F.count("*") - 1).alias("df"))
    return whole.withColumn("p", chi2_p("statistic", "df"))


#: Standard deviations from the likeliest table, and tables beyond those, after which chances are below the smallest number.
FAR, MORE = 60, 300


def fisher_exact(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p): two-sided exact test of 2 x 2 tables (a, b, c, d): tables no likelier than the one seen, with its margins.

    Chances go by ratios of neighbouring tables from the likeliest one outwards, on both sides, as far as they count: some
    hundred standard deviations, which grow with the root of the margins. No factorial and no row for a table is made.
    """
    d = lambda c: F.col(c).cast("double")
    base = tables.select(*keys, d("a").alias("_a"), (d("a") + d("b")).alias("_r"), (d("c") + d("d")).alias("_s"), (d("a") + d("c")).alias("_c"))
    r, s, c, a = (F.col(x) for x in ("_r", "_s", "_c", "_a"))
    n = r + s
    low, high = F.greatest(F.lit(0.0), c - s), F.least(r, c)
    top = F.least(F.greatest(F.floor((r + 1) * (c + 1) / (n + 2)).cast("double"), low), high)
    reach = F.ceil(FAR * F.sqrt(r * s * c * (n - c) / F.greatest(n * n * F.greatest(n - 1, F.lit(1.0)), F.lit(1.0)))) + MORE
    base = base.withColumns({"_top": top, "_low": F.greatest(low, top - reach), "_high": F.least(high, top + reach)})
    none = F.array().cast("array<long>")
    steps = lambda begin, end, forth: F.when(begin <= end if forth else begin >= end, F.sequence(begin.cast("long"), end.cast("long"), F.lit(1 if forth else -1).cast("long"))).otherwise(none)
    up = lambda x: (r - x + 1) * (c - x + 1) / (x * (s - c + x))  # noqa: E731  chance of x over that of x - 1
    down = lambda x: (x + 1) * (s - c + x + 1) / ((r - x) * (c - x))  # noqa: E731  chance of x over that of x + 1
    peak, first, last = F.col("_top"), F.col("_low"), F.col("_high")
    product = lambda places, ratio: F.aggregate(places, F.lit(1.0), lambda t, x: t * ratio(x))
    seen = F.when((a > last) | (a < first), 0.0).otherwise(product(steps(peak + 1, F.least(a, last), True), up) * product(steps(peak - 1, F.greatest(a, first), False), down))
    base = base.withColumn("_seen", seen * (1 + 1e-7))

    def side(places: Column, ratio) -> Column:
        """(chance so far, sum of all, sum of those no likelier than the one seen)."""
        start = F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("whole"), F.lit(0.0).alias("rare"))

        def add(state: Column, x: Column) -> Column:
            t = state["t"] * ratio(x)
            return F.struct(t.alias("t"), (state["whole"] + t).alias("whole"), (state["rare"] + F.when(t <= F.col("_seen"), t).otherwise(0.0)).alias("rare"))

        return F.aggregate(places, start, add)

    rows = base.withColumns({"_above": side(steps(peak + 1, last, True), up), "_below": side(steps(peak - 1, first, False), down)})
    rare = F.when(F.col("_seen") >= 1, 1.0).otherwise(0.0) + F.col("_above.rare") + F.col("_below.rare")
    return rows.select(*keys, F.least(F.lit(1.0), rare / (1.0 + F.col("_above.whole") + F.col("_below.whole"))).alias("p"))


def ks_2sample(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """(keys, statistic, p) of the two groups that sort first and last; nulls left out; null without both groups.

    Values are counted first, so running counts go over distinct values, in ranges of them (running.py).
    """
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    ends = rows.groupBy(*keys).agg(F.min(group).alias("_g1"), F.max(group).alias("_g2"))
    counts = rows.join(ends, keys).groupBy(*keys, value).agg(F.sum((F.col(group) == F.col("_g1")).cast("double")).alias("_n1"), F.sum((F.col(group) == F.col("_g2")).cast("double")).alias("_n2"), F.max((F.col("_g1") != F.col("_g2"))).alias("_two"))
    running = running_sums(counts, keys, value, ["_n1", "_n2"])
    whole = beside(running, counts.groupBy(*keys).agg(F.sum("_n1").alias("_a"), F.sum("_n2").alias("_b"), F.max("_two").alias("_both")), keys)
    gap = F.abs(F.col("_upto__n1") / F.col("_a") - F.col("_upto__n2") / F.col("_b"))
    found = whole.groupBy(*keys).agg(F.when(F.max("_both"), F.max(gap)).alias("statistic"), F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return found.withColumn("p", ks_p(F.col("statistic") * F.sqrt(F.col("_a") * F.col("_b") / (F.col("_a") + F.col("_b"))))).select(*keys, "statistic", "p")


def kruskal(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """(keys, statistic, df, p) with the tie correction; nulls left out; null with under two groups or one value."""
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    ties = rows.groupBy(*keys, value).agg(F.count("*").alias("_t"))
    running = running_sums(ties, keys, value, ["_t"])
    ranks = running.select(*keys, value, (F.col("_upto__t") - F.col("_t") + (F.col("_t") + 1) / 2).alias("_rank"))
    groups = rows.join(ranks, [*keys, value]).groupBy(*keys, group).agg(F.sum("_rank").alias("_sum"), F.count("*").alias("_n"))
    parts = groups.groupBy(*keys).agg(F.sum(F.col("_sum") * F.col("_sum") / F.col("_n")).alias("_s"), F.sum("_n").alias("_n"), (F.count("*") - 1).alias("df"))
    tied = ties.groupBy(*keys).agg(F.sum(F.pow(F.col("_t").cast("double"), 3) - F.col("_t")).alias("_tied"))
    n = F.col("_n").cast("double")
    h = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    correction = 1 - F.col("_tied") / (n * n * n - n)
    found = parts.join(tied, keys).withColumn("statistic", F.when((F.col("df") > 0) & (n > 1) & (correction > 0), h / correction))
    return found.withColumn("p", chi2_p("statistic", "df")).select(*keys, "statistic", "df", "p")


def cluster_tests(members: DataFrame, run: list[str], k: int, p_threshold: float | None = None, counts: list[str] | None = None, measures: list[str] | None = None) -> DataFrame:
    """(run, measure, p) in long form: members(run, cluster, 0/1 columns counts, numeric columns measures).

    k <= 2: Fisher for counts, Kolmogorov-Smirnov for measures; else chi-square and Kruskal-Wallis. With a threshold only
    rows with p <= it.
    """
    counts, measures = counts or [], measures or []
    long = lambda cols: members.unpivot([*run, "cluster"], cols, "measure", "value")
    keys, found = [*run, "measure"], []
    if counts:
        table = long(counts).groupBy(*keys, "cluster").agg(F.sum("value").alias("hits"), F.count("value").alias("total"))
        if k <= 2:
            ends = table.groupBy(*keys).agg(F.min_by(F.struct("hits", "total"), "cluster").alias("x"), F.max_by(F.struct("hits", "total"), "cluster").alias("y"))
            cells = ends.select(*keys, F.col("x.hits").alias("a"), (F.col("x.total") - F.col("x.hits")).alias("b"), F.col("y.hits").alias("c"), (F.col("y.total") - F.col("y.hits")).alias("d"))
            found.append(fisher_exact(cells, keys).select(*keys, "p"))
        else:
            found.append(chi2_counts(table, keys, "hits", "total", "cluster").select(*keys, "p"))
    if measures:
        test = ks_2sample if k <= 2 else kruskal
        found.append(test(long(measures), keys, "value", "cluster").select(*keys, "p"))
    whole = found[0] if len(found) == 1 else found[0].union(found[1])
    return whole if p_threshold is None else whole.filter(F.col("p") <= p_threshold)


def p_level(p: str, strict: float = 0.05, loose: float = 0.1):
    """2 below strict, 1 below loose, else 0; null is 0."""
    return F.when(F.col(p) < strict, 2).when(F.col(p) < loose, 1).otherwise(0)


def p_profile(both: DataFrame, strict: float = 0.05, loose: float = 0.1) -> DataFrame:
    """Add levels: [level of p1, level of p2] to rows of two cohorts."""
    return both.withColumn("levels", F.array(p_level("p1", strict, loose), p_level("p2", strict, loose)))


def adjust_bh(df: DataFrame, p: str, groups: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg: the running least, from the largest p down, of p * m / rank, at most 1; null p stays null."""
    known = F.col(p).isNotNull()
    own = Window.partitionBy(*groups, known)
    rank = F.row_number().over(own.orderBy(p))
    raw = df.withColumn("_raw", F.when(known, F.col(p) * F.count("*").over(own) / rank))
    down = own.orderBy(F.desc(p), F.desc("_raw")).rowsBetween(Window.unboundedPreceding, 0)
    least = F.min("_raw").over(Window.partitionBy(*groups, known, p))  # ties share the value of their last rank
    return raw.withColumn("_raw", least).withColumn(out, F.when(known, F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw")
