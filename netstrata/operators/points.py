"""Trees of points in the plane by Euclidean distance, without a table of all pairs.

Equal points are merged first, at height 0, the first one with each other one in order, as linkage does. Different points
go to tasks as arrays, 32 bytes each with the cluster they are in, up to ``MOST`` of them (counted); distances are made where they are
compared and never stored, so a tree takes time as the square of different points but no disk. Single linkage takes a least
spanning tree, in rounds in which each cluster finds its nearest point outside. Ward's method and averages merge all
reciprocal nearest pairs of a round; a cluster's nearest one is found again only if either of them merged. Ward's distance
comes from centroids and sizes. An average lies between the distance of the centroids and that with both mean deviations
added, so only clusters that can be nearest are compared point by point. The last ``IN_TASK`` clusters are one task's square
matrix, whose rows all tasks make. Beyond ``MOST``, and for other methods, pairs are made and linked (hierarchy.linkage).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dealt import over
from ..functions.scratch import materialise
from . import hierarchy
from .hierarchy import IN_TASK

#: Points that tasks hold as arrays, and distances that one makes at once.
MOST, CELLS = 1 << 20, 1 << 18
METHODS = ("single", "average", "ward")


def apart(points: DataFrame) -> DataFrame:
    """(id_a, id_b, distance) of all pairs of points(id, x, y)."""
    pairs = points.toDF("id_a", "xa", "ya").join(points.toDF("id_b", "xb", "yb"), F.col("id_a") < F.col("id_b"))
    return pairs.select("id_a", "id_b", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("distance"))


def _distances(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray | slice = slice(None)) -> np.ndarray:
    d, e = x[rows, None] - x[None, columns], y[rows, None] - y[None, columns]
    return np.sqrt(d * d + e * e)


@dataclass(frozen=True)
class Clusters:
    """Clusters of points: their places, sizes, centroids and mean deviations, and the points in order of their clusters."""

    node: np.ndarray
    size: np.ndarray
    cx: np.ndarray
    cy: np.ndarray
    deviation: np.ndarray
    start: np.ndarray
    x: np.ndarray
    y: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, cluster: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Clusters:
        order = np.argsort(cluster, kind="stable")
        node, start, count = np.unique(cluster[order], return_index=True, return_counts=True)
        x, y, n = x[order], y[order], n[order]
        total = lambda v: np.add.reduceat(v, start)
        size = total(n)
        # a cluster of one point has just that point for its centroid
        cx, cy = (np.where(count == 1, v[start], total(v * n) / size) for v in (x, y))
        off = np.sqrt((x - np.repeat(cx, count)) ** 2 + (y - np.repeat(cy, count)) ** 2)
        return cls(node, size, cx, cy, total(off * n) / size, np.append(start, len(x)), x, y, n)

    def averages(self, one: int, others: np.ndarray) -> np.ndarray:
        """Average distances of a cluster to others."""
        low, count = self.start[others], self.start[others + 1] - self.start[others]
        ends = np.cumsum(count)
        cells = np.repeat(low - ends + count, count) + np.arange(int(ends[-1]))
        own = np.arange(self.start[one], self.start[one + 1])
        x, y, whole = self.x[cells], self.y[cells], np.zeros(len(cells))
        step = max(1, CELLS // len(cells))
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            d, e = self.x[mine, None] - x[None, :], self.y[mine, None] - y[None, :]
            whole += self.n[mine] @ np.sqrt(d * d + e * e)
        return np.add.reduceat(whole * self.n[cells], ends - count) / (self.size[one] * self.size[others])

    def nearest(self, which: np.ndarray, method: str) -> tuple[np.ndarray, np.ndarray]:
        """(places in node, distances) of the nearest cluster of each, of equally near ones the first."""
        near, height = np.zeros(len(which), np.int64), np.zeros(len(which))
        step = max(1, CELLS // len(self.node))
        for at in range(0, len(which), step):
            rows = which[at : at + step]
            d = _distances(self.cx, self.cy, rows)
            if method == "ward":
                a, b = self.size[rows, None], self.size[None, :]
                d *= np.sqrt(2 * (a * b) / (a + b))
            d[np.arange(len(rows)), rows] = np.inf
            if method == "average":
                for i, row in enumerate(rows):
                    upper = d[i] + (self.deviation + self.deviation[row])
                    able = np.flatnonzero(d[i] <= upper.min() * (1 + 1e-9))
                    found = self.averages(row, able) if len(able) > 1 or upper[able[0]] > d[i][able[0]] else d[i][able]
                    best = int(found.argmin())
                    near[at + i], height[at + i] = able[best], found[best]
            else:
                near[at : at + step] = d.argmin(axis=1)
                height[at : at + step] = d[np.arange(len(rows)), near[at : at + step]]
        return near, height

    def to_later(self, row: int, method: str) -> np.ndarray:
        """Distances of a cluster to all that come after it."""
        later = np.arange(row + 1, len(self.node))
        if method == "average":
            return self.averages(row, later)
        a, b = self.size[row], self.size[later]
        return _distances(self.cx, self.cy, np.array([row]), later)[0] * np.sqrt(2 * (a * b) / (a + b))


def _rounds(spark: SparkSession, x: np.ndarray, y: np.ndarray, n: np.ndarray, method: str, in_task: int) -> list[tuple[np.ndarray, ...]]:
    """(left, right, height, size) of the merges of points by their places."""
    cluster, merges = np.arange(len(x)), []
    near, height = np.full(len(x), -1), np.full(len(x), np.inf)
    stale, left = np.arange(len(x)), len(x)
    while left > in_task:
        now = Clusters.of(cluster, x, y, n)
        held = spark.sparkContext.broadcast(now)

        def find(which: np.ndarray, held=held) -> Iterator[pa.RecordBatch]:
            rows = np.searchsorted(held.value.node, which)
            found, d = held.value.nearest(rows, method)
            yield pa.record_batch([pa.array(which), pa.array(held.value.node[found].astype(np.int64)), pa.array(d)], ["node", "near", "d"])

        found = over(spark, stale, find, "node long, near long, d double").toArrow()  # 24 bytes a cluster
        held.unpersist()
        node = found["node"].to_numpy()
        near[node], height[node] = found["near"].to_numpy(), found["d"].to_numpy()
        a = now.node[(near[near[now.node]] == now.node) & (now.node < near[now.node])]
        if not len(a):  # last bits of equal distances differ between the two sides: the least pair is merged
            one = now.node[np.lexsort((now.node, height[now.node]))[0]]
            a, b = np.sort([one, near[one]])[:, None]
            near[a], near[b], height[a] = b, a, height[one]
        b = near[a]
        size = np.zeros(len(x), np.int64)
        size[now.node] = now.size
        merges.append((a, b, height[a], size[a] + size[b]))
        to, merged = np.arange(len(x)), np.zeros(len(x), bool)
        to[b], merged[a], merged[b] = a, True, True
        cluster = to[cluster]
        alive = np.setdiff1d(now.node, b, assume_unique=True)
        stale, left = alive[merged[alive] | merged[near[alive]]], len(alive)
    now = Clusters.of(cluster, x, y, n)
    held = spark.sparkContext.broadcast(now)

    def rows(which: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = [held.value.to_later(int(row), method) for row in which]
        count = np.array([len(d) for d in own])
        later = [np.arange(row + 1, row + 1 + len(d)) for row, d in zip(which, own, strict=True)]
        yield pa.record_batch([pa.array(np.repeat(which, count)), pa.array(np.concatenate(later)), pa.array(np.concatenate(own))], ["x", "y", "d"])

    if len(now.node) > 1:
        pairs = over(spark, np.arange(len(now.node) - 1), rows, "x long, y long, d double")
        sizes = spark.createDataFrame(pd.DataFrame({"node": np.arange(len(now.node)), "n": now.size}))
        rest = hierarchy._in_task(pairs, sizes, hierarchy._schema("long"), lambda d, size, names, _: hierarchy._table(names, hierarchy._tree(d, size, method))).toArrow()
        merges.append((now.node[rest["left"].to_numpy()], now.node[rest["right"].to_numpy()], rest["height"].to_numpy(), rest["size"].to_numpy()))
    return merges


def _spanning(spark: SparkSession, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (u, v, d) of the least spanning tree of points by their places, least by (d, u, v)."""
    cluster, edges = np.arange(len(x)), []
    while (cluster != cluster[0]).any():
        held = spark.sparkContext.broadcast((x, y, cluster))

        def find(which: np.ndarray, held=held) -> Iterator[pa.RecordBatch]:
            x, y, cluster = held.value
            near, least = np.zeros(len(which), np.int64), np.zeros(len(which))
            step = max(1, CELLS // len(x))
            for at in range(0, len(which), step):
                rows = which[at : at + step]
                d = _distances(x, y, rows)
                d[cluster[rows, None] == cluster[None, :]] = np.inf
                near[at : at + step] = best = d.argmin(axis=1)
                least[at : at + step] = d[np.arange(len(rows)), best]
            yield pa.record_batch([pa.array(which), pa.array(near), pa.array(least)], ["node", "near", "d"])

        found = over(spark, np.arange(len(x)), find, "node long, near long, d double").toArrow()  # 24 bytes a point
        held.unpersist()
        node, near, d = (found[c].to_numpy() for c in ("node", "near", "d"))
        u, v = np.minimum(node, near), np.maximum(node, near)
        order = np.lexsort((v, u, d, cluster[node]))
        first = order[np.r_[True, np.diff(cluster[node][order]) != 0]]
        chosen = np.unique(np.stack([u[first], v[first]]), axis=1, return_index=True)[1]
        u, v, d = u[first][chosen], v[first][chosen], d[first][chosen]
        edges.append((u, v, d))
        up = np.arange(len(x))  # each cluster points to the one its edge goes to, of two that choose each other the first stays
        other = np.where(cluster[node[first]] == cluster[np.minimum(node, near)[first]], cluster[np.maximum(node, near)[first]], cluster[np.minimum(node, near)[first]])
        own = cluster[node[first]]
        up[own] = other
        both = own[(up[up[own]] == own) & (own < up[own])]
        up[both] = both
        while (up[up] != up).any():
            up = up[up]
        cluster = up[cluster]
    return tuple(np.concatenate([e[i] for e in edges]) for i in range(3)) if edges else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def linkage_points(points: DataFrame, method: str, in_task: int = IN_TASK, most: int = MOST) -> DataFrame:
    """hierarchy.linkage of points(id, x, y) by their distances; ids sort like numbers or text, coordinates aren't null."""
    if method not in hierarchy.METHODS:
        raise ValueError(f"unknown method: {method}")
    spark = points.sparkSession
    points = materialise(points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    distinct = points.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    if method not in METHODS or points.count() <= in_task or distinct.count() > most:
        return hierarchy.linkage(materialise(apart(points), "distances"), method, in_task)
    kind = dict(points.dtypes)["id"]
    held = distinct.toArrow().sort_by("id")
    names, x, y, n = held["id"].combine_chunks(), held["x"].to_numpy(), held["y"].to_numpy(), held["n"].to_numpy()
    own = Window.partitionBy("x", "y")
    first = points.withColumns({"left": F.min("id").over(own), "size": F.row_number().over(own.orderBy("id")).cast("long")}).filter("size > 1")
    if method == "single":
        u, v, d = _spanning(spark, x, y)
        edges = spark.createDataFrame(pa.table([names.take(pa.array(u)), names.take(pa.array(v)), pa.array(d)], ["u", "v", "d"])).select(F.col("u").cast(kind), F.col("v").cast(kind), "d")
        whole = materialise(edges.union(first.select("left", "id", F.lit(0.0))), "spanning-tree")
        return hierarchy.from_spanning(whole, kind)
    merges = _rounds(spark, x, y, n, method, in_task)
    a, b, height, size = (np.concatenate([np.asarray(m[i]) for m in merges]) if merges else np.zeros(0, int if i != 2 else float) for i in range(4))
    a, b = np.minimum(a, b), np.maximum(a, b)
    made = spark.createDataFrame(pa.table([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(height), pa.array(size.astype(np.int64))], ["left", "right", "height", "size"]))
    made = made.select(F.col("left").cast(kind), F.col("right").cast(kind), "height", "size")
    return hierarchy._stepped(materialise(made.union(first.select("left", F.col("id").alias("right"), F.lit(0.0), "size")), "linkage-merges"))


def leaf_pairs(points: DataFrame, order: DataFrame) -> DataFrame:
    """(row, column, distance) of all pairs of points by their places in order(id, position), each pair once, row < column."""
    placed = materialise(points.join(order, "id").select("position", "x", "y"), "placed")
    tasks = max(placed.sparkSession.sparkContext.defaultParallelism, -(-placed.count() // 256))
    a, b = placed.toDF("row", "xa", "ya").repartition(tasks), placed.toDF("column", "xb", "yb")
    pairs = a.join(F.broadcast(b), F.col("row") < F.col("column"))  # 24 bytes a point
    return pairs.select("row", "column", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("distance"))


def cophenetic_correlation(points: DataFrame, merges: DataFrame, most: int = MOST) -> DataFrame:
    """(correlation) of the distances of all pairs of points with the heights at which merges join them.

    In leaf order a pair's height is the largest of the heights between its neighbouring places. Tasks hold points and heights
    in that order, 24 bytes each, and sum up pairs place by place; beyond ``most`` points pairs are made and joined.
    """
    if merges.count() >= most:
        return hierarchy.cophenetic_correlation(apart(points), merges)
    places, heights = hierarchy.leaf_heights(merges)
    own = points.join(places, "id").join(heights, "position", "left").select("position", F.col("x").cast("double"), F.col("y").cast("double"), "height").toArrow().sort_by("position")
    x, y, height = (own[c].to_numpy() for c in ("x", "y", "height"))
    if len(x) < 2:
        return points.sparkSession.createDataFrame([(None,)], "correlation double")
    # sums of what differs from about the middle lose few digits
    middle = float(np.sqrt(2 * (x.var() + y.var()))), float(np.mean(height[1:]))
    held = points.sparkSession.sparkContext.broadcast((x, y, height))

    def sums(which: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, y, height = held.value
        out = np.zeros((len(which), 6))
        for i, row in enumerate(which):
            d = np.sqrt((x[row] - x[row + 1 :]) ** 2 + (y[row] - y[row + 1 :]) ** 2) - middle[0]
            h = np.maximum.accumulate(height[row + 1 :]) - middle[1]
            out[i] = len(d), d.sum(), h.sum(), d @ d, h @ h, d @ h
        yield pa.record_batch(list(out.sum(axis=0, keepdims=True).T), ["n", "d", "h", "dd", "hh", "dh"])

    parts = over(points.sparkSession, np.arange(len(x) - 1), sums, "n double, d double, h double, dd double, hh double, dh double")
    total = parts.agg(*(F.sum(c).alias(c) for c in parts.columns))
    of = lambda a, b, both: F.col("n") * F.col(both) - F.col(a) * F.col(b)
    spread = F.sqrt(of("d", "d", "dd") * of("h", "h", "hh"))
    return total.select((of("d", "h", "dh") / F.when(spread > 0, spread)).alias("correlation"))
