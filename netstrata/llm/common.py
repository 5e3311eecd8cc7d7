"""What the operators of this folder share: reading tables, shared scratch folders, cutting lineage, Arrow helpers."""

from __future__ import annotations

import os
from collections.abc import Callable, Hashable, Iterator
from functools import cache, wraps
from typing import Any, BinaryIO

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import materialise, new_path, shared_dir, temporary

__all__ = ["create", "delete", "few", "forget", "kept", "keeps_columns", "local_path", "materialise", "new_path", "read_at", "shared_dir", "single_threaded", "slices", "table", "temporary"]

#: Rows of an Arrow batch that a Python step holds as Python objects at once.
SLICE_ROWS = 128
#: Rows up to which a counted table of a few numbers each is broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one in fewer splits than there are cores, as a small file is, is dealt over them first."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut batches small, so that long texts don't pile up as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def keeps_columns(*results: str, reads: tuple[str, ...] = ()) -> Callable:
    """For functions of a table that return its columns and ``results``. Helper columns begin with an underscore, so columns
    of the input that do are set aside under other names meanwhile, but for those in ``reads``; a column that is named as a
    result, in any case of letters, is replaced by it."""

    def decorate(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(function)
        def run(docs: DataFrame, *given, **more) -> DataFrame:
            aside = {c: f"aside{i}" for i, c in enumerate(docs.columns) if c.startswith("_") and c not in reads}
            while set(aside.values()) & {c.lower() for c in docs.columns}:
                aside = {c: f"{other}x" for c, other in aside.items()}
            replaced = {c for c in docs.columns if c.lower() in results and c not in reads}
            named = docs.select(*(docs[f"`{c}`"].alias(aside.get(c, c)) for c in docs.columns if c not in replaced)) if aside else docs
            out = function(named, *given, **more)
            return out.withColumnsRenamed({other: c for c, other in aside.items() if c not in replaced}) if aside else out

        return run

    return decorate


_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between tasks, such as a tokenizer with the words it knows. It is one thing at a time:
    Spark uses workers again for later stages, which have no use for the models of earlier ones."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Free what this worker keeps; steps without a model begin with it."""
    _KEPT.clear()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing needs any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with the hint to broadcast it if it has at most so many rows, which are counted; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mounted(path: str) -> bool:
    return path.rpartition(":")[0] in ("", "file")


@cache
def _folder(uri: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(uri.replace("s3a:", "s3:", 1))


def create(path: str) -> BinaryIO:
    """A new file of the shared folder, which need not be mounted, to write from its start to its end."""
    folder, _, name = path.rpartition("/")
    if mounted(path):
        os.makedirs(local_path(folder), exist_ok=True)
        return open(local_path(path), "wb")
    files, inner = _folder(folder)
    files.create_dir(inner)
    return files.open_output_stream(f"{inner}/{name}")


def read_at(path: str, place: int, size: int) -> bytes:
    """Bytes of a file of the shared folder, which need not be mounted."""
    if mounted(path):
        with open(local_path(path), "rb") as whole:
            whole.seek(place)
            return whole.read(size)
    folder, _, name = path.rpartition("/")
    files, inner = _folder(folder)
    with files.open_input_file(f"{inner}/{name}") as whole:
        return whole.read_at(size, place)


def local_path(path: str) -> str:
    """A path of the shared folder as one of this machine, for files that tasks write and map themselves."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"this step needs a shared folder that is mounted, not {path}")
    return "/" + rest.lstrip("/")


def single_threaded() -> None:
    """Spark already runs one Python worker for each core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
