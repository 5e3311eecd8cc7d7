"""Tables in the folder that driver and executors share; they cut the lineage of iterations."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder where it is unset and everything runs on this machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class _Scopes(threading.local):
    def __init__(self):
        self.made: list[list[str]] = []


_SCOPES = _Scopes()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES.made:
        _SCOPES.made[-1].append(path)
    return path


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes, at the end of the block, what was written to new paths in it, but for tables written by the function given.

    Only results written that way may be used afterwards: with temporary(spark) as result: ... return result(df, name).
    """
    made: list[str] = []
    _SCOPES.made.append(made)

    def result(df: DataFrame, name: str) -> DataFrame:
        _SCOPES.made.pop()
        try:
            return materialise(df, name)
        finally:
            _SCOPES.made.append(made)

    try:
        yield result
    finally:
        _SCOPES.made.pop()
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Lets Spark delete the shuffle files of a query when it ends, instead of when the driver next collects its garbage.
EARLY_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again. What its query shuffled isn't needed then and goes at once."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(EARLY_CLEANUP, None)
    conf.set(EARLY_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(EARLY_CLEANUP) if before is None else conf.set(EARLY_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str = "_row") -> DataFrame:
    """Add the place of each row, from 0, in the order of unique keys: rows are sorted in ranges, and the ranges' counts,
    one for each task, give where each range begins."""
    placed = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before, starts = 0, []
    for which, n in counts:
        starts.append((which, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    whole = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return whole.withColumn(name, F.col("_before") + place).drop("_at", "_part", "_before")
