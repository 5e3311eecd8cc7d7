"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are cut at multiples of the sequence length; all pieces, full ones included, are dealt to groups by a hash of
document, piece and the row's place in its task, so rows without a doc_id, or many of one, spread like others. Every group
is packed on its own, in Arrow, where ids beside a null stay whole. A group has about ``GROUP_PIECES`` pieces whatever the
size of the input, which is counted in pieces, so a task's memory doesn't grow with it. Sequences are padded to the full length unless their fill is a
power of two.

Nulls and odd input: a null or empty text is the end id alone. Null doc_ids stay null. Rows with equal doc_id are packed
one by one. A very long text gives many pieces, in as many groups as there are. An empty table packs to no rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, slices, table
from .tokens import END_ID, default_tokenizer, encoder, utf8

SEQUENCE = 4096
GROUP_PIECES = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenised_pieces(docs: DataFrame, capacity: int = SEQUENCE, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of capacity: position, length and CRC32 of every piece."""
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, got in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(utf8(batch.column("text"))), strict=True):
                ids = memoryview(got + end)
                n = len(ids) // 4
                rows += [(doc_id, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def first_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, in the order given; a tournament tree has the largest room below each node."""
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for need in lengths:
        at = 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= need else 2 * at + 1
        bins.append(at - leaves)
        offsets.append(capacity - room[at])
        room[at] -= need
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins, offsets


def pack(pieces: DataFrame, n_pieces: int, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 42) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, start and length (1 to capacity); n_pieces sets the number of groups only."""
    groups = max(1, -(-n_pieces // group_pieces))
    names = pieces.columns

    def fill(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        bins, offsets = first_fit(rows["length"].to_pylist(), capacity)
        first = rows["pack_group"][0].as_py() << 32
        placed = rows.select(names).append_column("sequence_id", pa.array(np.array(bins, np.int64) + first))
        return placed.append_column("offset", pa.array(np.array(offsets, np.int64)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = materialise(tokenised_pieces(table(spark, sf_dir, "documents")), "pieces")
    return pack(pieces, pieces.count())
