"""Nearest neighbours: vantage-point trees over shards of the rows, searched for every query that can have a neighbour there.

A router, a vantage-point tree fitted on a bounded sample, deals every row to a shard of near vectors. A query first looks in
its own shard, which gives the distance of its k-th neighbour so far; then in all other shards that can hold something
nearer by the triangle inequality. A shard of more than ``CROWDED`` times the usual rows, such as one of copies, is dealt to
several tasks. A task builds the trees of the shards dealt to it one at a time, and queries stream past them in Arrow batches;
rows are never copied, queries are for each shard they visit. ``stretch`` relaxes pruning between shards and within trees
(see vptree): 1 makes the search exact, and more leaves out more.

Nulls and odd input: null, empty or zero vectors and those with null or non-finite components take no part. Only vectors of
equal length are compared: a length other than that of most of the sample goes to shards of its own. A row without a vec_id
is a candidate, with a null vec_id in the result and last among ties, but no query. A query leaves out all rows with its id;
queries that are equal in id and vector are one. Copies tie, and go by vec_id; repeated candidates keep their rows. Empty
tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, materialise, table, temporary
from .vptree import NONE, Router, Tree

K = 10
#: Factor of the pruning, of which 1 is exact; see README for recall and work.
STRETCH = 2.0
#: Rows a shard aims at: ROWS_A_ROOT times the square root of all rows, within bounds. Queries x shards then grow no faster
#: than queries x roots, and a tree stays a small part of a task's memory.
ROWS_A_ROOT, LEAST_ROWS, MOST_ROWS = 4, 256, 65_536
#: Shards of a router at most (one vector each is broadcast), the sample's vectors a shard, and in all.
MOST_SHARDS, SAMPLE_A_SHARD, MOST_SAMPLE = 4096, 32, 65_536
#: Times the usual rows from which a shard is dealt to several tasks.
CROWDED = 2
#: Queries searched together.
BLOCK = 256


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (long) and embedding (doubles) of rows that take part."""
    e = F.col("embedding")
    finite = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit_router(rows: DataFrame, n: int) -> Router:
    """A router for n rows, from at most MOST_SAMPLE rows drawn by hash."""
    wanted = min(MOST_ROWS, max(LEAST_ROWS, ROWS_A_ROOT * math.isqrt(n)))
    shards = min(MOST_SHARDS, max(1, math.ceil(n / wanted)))
    drawn = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(min(MOST_SAMPLE, SAMPLE_A_SHARD * shards)).select("embedding").toArrow()["embedding"]
    lists = drawn.combine_chunks() if drawn.num_chunks != 1 else drawn.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    usual = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    return Router(_matrix(lists.filter(pa.array(sizes == usual))), shards) if len(sizes) else Router(np.zeros((0, 1)), 1)


def _of_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length of vectors in a batch."""
    sizes = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, _matrix(batch.column("embedding").take(pa.array(rows)))


def _width(router: Router) -> int:
    return router.vantages.shape[1] if len(router.points) else 0


def _shard_of(router: Router, vectors: np.ndarray) -> np.ndarray:
    """Its shard; vectors of another length have one for each length, below 0."""
    if len(router.points) and vectors.shape[1] != _width(router):
        return np.full(len(vectors), -1 - vectors.shape[1])
    return router.shard(vectors)


def route(rows: DataFrame, router: Router) -> DataFrame:
    """rows with their shard, and a number that tells equal rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            shard = np.zeros(batch.num_rows, np.int64)
            for at, vectors in _of_length(batch):
                shard[at] = _shard_of(router, vectors)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard)], ["vec_id", "embedding", "shard"])

    return rows.mapInArrow(run, "vec_id long, embedding array<double>, shard long").withColumn("row", F.monotonically_increasing_id())


def visits(queries: DataFrame, router: Router, stretch: float) -> DataFrame:
    """queries with the shards other than their own that can hold a row within their reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
            lists: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            home, reach = batch.column("shard").to_numpy(), batch.column("reach").to_numpy()
            for at, vectors in _of_length(batch):
                if len(router.points) and vectors.shape[1] == _width(router):
                    near = router.least(vectors) * stretch <= reach[at][:, None]
                    near[np.arange(len(at)), home[at]] = False
                    for i, row in zip(at, near, strict=True):
                        lists[i] = np.flatnonzero(row)
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            shards = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "reach")), shards], ["vec_id", "embedding", "reach", "shards"])

    far = queries.select("vec_id", "embedding", "reach", "shard").mapInArrow(run, "vec_id long, embedding array<double>, reach double, shards array<long>")
    return far.select("vec_id", "embedding", "reach", F.explode("shards").alias("shard"))


def search(rows: DataFrame, looking: DataFrame, k: int, stretch: float) -> DataFrame:
    """(query_id, query, vec_id, score) of the k nearest rows of its shard for each of looking(vec_id, embedding, reach, shard).

    rows have their shard and part; a query goes to all parts of its shard. A partition holds shards in turn, a shard's rows
    before its queries, so memory is one tree and one batch of queries.
    """
    parts = rows.groupBy("shard").agg((F.max("part") + 1).alias("parts"))
    dealt = looking.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    order = ["shard", "part", "role"]
    both = rows.select("shard", "part", F.lit(0).alias("role"), "vec_id", "embedding", F.lit(0.0).alias("reach"))
    both = both.union(dealt.select("shard", "part", F.lit(1), "vec_id", "embedding", "reach")).repartition("shard", "part").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        now, held, tree = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in order])
            cuts = np.r_[0, 1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)), batch.num_rows] if batch.num_rows else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part, shard, role = batch.slice(a, b - a), tuple(keys[:2, a]), keys[2, a]
                if shard != now:
                    now, held, tree = shard, [], None
                ids = part.column("vec_id").fill_null(NONE).to_numpy()
                vectors = _matrix(part.column("embedding"))
                if role == 0:
                    held.append((vectors, ids))
                    continue
                if tree is None and held:
                    tree = Tree(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held]))
                    held = []
                for at in range(0, len(ids) if tree else 0, BLOCK):
                    piece = slice(at, at + BLOCK)
                    score, found = tree.nearest(vectors[piece], ids[piece], part.column("reach").to_numpy()[piece], k, stretch)
                    i, j = np.nonzero(np.isfinite(score))
                    if len(i):
                        name = pa.array(found[i, j], mask=found[i, j] == NONE)
                        yield pa.RecordBatch.from_arrays([part.column("vec_id").slice(at, BLOCK).take(pa.array(i)), part.column("embedding").slice(at, BLOCK).take(pa.array(i)), name, pa.array(score[i, j])], ["query_id", "query", "vec_id", "score"])

    return both.mapInArrow(run, "query_id long, query array<double>, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query_id", "query").orderBy("score", F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, which: Column, k: int = K, stretch: float = STRETCH) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest rows of each row that ``which`` names among those that take part."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    router = fit_router(rows, rows.count())
    with temporary(spark) as result:
        routed = materialise(route(rows, router), "routed")
        sizes = materialise(routed.groupBy("shard").count(), "shard-sizes")
        usual = max(LEAST_ROWS, (sizes.agg(F.sum("count")).first()[0] or 0) // max(1, router.shards))
        most = F.ceil(F.col("count") / F.lit(CROWDED * usual))
        # one row for each shard of the router, and for each other length of vectors
        dealt = routed.join(F.broadcast(sizes.select("shard", most.alias("parts"))), "shard").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
        dealt = materialise(dealt.select("shard", "part", "vec_id", "embedding"), "shards")
        queries = materialise(routed.filter(F.col("vec_id").isNotNull() & which).dropDuplicates(["vec_id", "embedding"]).select("vec_id", "embedding", "shard"), "queries")
        home = materialise(_ranked(search(dealt, queries.withColumn("reach", F.lit(float("inf"))), k, stretch), k), "home")
        reach = home.filter(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("query").alias("_v"), F.col("score").alias("_r"))
        known = queries.join(reach, (F.col("vec_id") == F.col("_q")) & (F.col("embedding") == F.col("_v")), "left").withColumn("reach", F.coalesce("_r", F.lit(float("inf"))))
        far = search(dealt, visits(known, router, stretch), k, stretch)
        whole = home.select("query_id", "query", "vec_id", "score").union(far)
        return result(_ranked(whole, k).select("query_id", "rank", "vec_id", "score"), "nearest")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
