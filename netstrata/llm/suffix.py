"""Suffix-array dedup: bytes of every 100-byte string that starts earlier elsewhere, found by external induced sorting.

1. Anchors. In every 100-byte string the 32-byte piece with the least hash is its anchor; equal strings have equal
   anchors at equal places. A document is thus a few anchors, and only anchors whose piece is seen twice go on.
2. Segments. All strings of an anchor lie within 68 bytes before and 100 bytes after its start. Equal segments are one
   class; all but the first of a class are removed whole, so thousands of copies of a passage end here.
3. Shards. Pieces with several classes are shards of the suffix sort. Spark sorts the segments of a shard by age, spilling
   as it does; a task reads them in that order. In a shard strings can only be equal at the same place from the anchor, so
   suffixes are sorted one place at a time, from the right: the order at a place is induced from the order at the next, by
   tuples (byte, suffix, common prefix with the one before) that go through a priority queue of a bucket for each byte.
   Queues, text and marks are arrays in memory up to ``2 * IN_MEMORY`` segments and files beyond, read and written in
   blocks. Neighbours with a common prefix of 100 bytes are equal strings; all but the first go.
4. A shard over ``CROWD`` segments is cut in two by halving the places: strings of the left half all hold the bytes up to
   its middle, those of the right half the bytes from there on, so each half is dealt again by a hash of those bytes. That
   goes on until shards are small or a shard has a single place, where all its strings are equal and the oldest is a minimum.
5. Spans are joined to their documents and cut out.

Nothing is sampled or capped. Nulls and odd input: a null text is an empty one; texts under 100 bytes lose nothing. Order
is (doc_id, text hash, position), null doc_id first; rows that are equal in doc_id and text share their fate. Very long
texts take memory in proportion in the task that reads them. Empty tables give no rows. Other columns of the input are kept by ``dedup``.
"""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, keeps_columns, materialise, slices, table, temporary

LENGTH = 100
PIECE = 32  # a power of two
REACH = LENGTH - PIECE
WIDTH = REACH + LENGTH
#: Fills segments past the ends of a document; no UTF-8 text has this byte.
OUTSIDE = 0xFF
#: Segments that a task sorts together, twice as many in memory; entries of a block of a queue; largest shard.
IN_MEMORY, BLOCK, CROWD = 16_000, 1 << 20, 500_000
#: Largest bitmap (2 ** 27 bits are 16 MB) by which anchors with single pieces are left out before the shuffle.
MOST_BITS = 27
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the anchors of all strings of LENGTH bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value = (data.astype(np.uint64) + np.uint64(1)) * _A
    value ^= value >> np.uint64(31)
    size, factor = 1, int(_B)
    while size < PIECE:
        value = value[:-size] * np.uint64(factor) + value[size:]
        size, factor = 2 * size, factor * factor % 2**64
    value ^= value >> np.uint64(32)
    value *= _A
    value ^= value >> np.uint64(29)
    least = (value & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(value), dtype=np.uint64)
    size, places = 1, LENGTH - PIECE + 1
    while 2 * size <= places:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < places:
        least = np.minimum(least[: len(least) - (places - size)], least[places - size :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.r_[True, at[1:] != at[:-1]]]
    return at, value[at]


def _array(folder: str | None, name: str, kind: type, shape: int | tuple[int, int]) -> np.ndarray:
    """An array in memory, or in a file of the folder if there is one."""
    return np.memmap(Path(folder, name), kind, "w+", shape=shape) if folder else np.empty(shape, kind)


class BucketQueue:
    """A priority queue of (byte, arrival) for tuples (suffix, common prefix with the tuple before): a bucket for each byte.

    The sizes of the buckets are known before, so the buckets lie one after another in one array for each field; the
    arrays are files if ``folder`` is given. What is pushed comes in the order of the place to the right, and reading the
    arrays through is popping.
    """

    def __init__(self, counts: np.ndarray, folder: str | None, name: str):
        n = int(counts.sum())
        self.suffix, self.prefix = _array(folder, f"{name}-suffix", np.int32, n), _array(folder, f"{name}-prefix", np.uint8, n)
        self.head = np.cumsum(counts) - counts
        self.first, self.since = np.ones(256, bool), np.zeros(256, np.uint8)

    def push(self, byte: np.ndarray, suffix: np.ndarray, prefix: np.ndarray) -> None:
        """Tuples in order; prefix: the common prefix with the tuple before, at the place to the right."""
        n = len(byte)
        order = np.argsort(byte, kind="stable")
        sorted_byte = byte[order]
        starts = np.flatnonzero(np.r_[True, sorted_byte[1:] != sorted_byte[:-1]])
        kinds = sorted_byte[starts]
        steps = [prefix]
        while 2 ** len(steps) <= n:
            half = 2 ** (len(steps) - 1)
            steps.append(np.minimum(steps[-1][:-half], steps[-1][half:]))

        def least(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Least of prefix[low .. high], both ends included."""
            level = np.frexp(high - low + 1)[1] - 1
            out = np.empty(len(low), np.uint8)
            for k in np.unique(level):
                own = level == k
                out[own] = np.minimum(steps[k][low[own]], steps[k][high[own] - 2**k + 1])
            return out

        between = np.zeros(n, np.uint8)
        inner = np.ones(n, bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        between[inner] = least(order[inner - 1] + 1, order[inner]) + 1
        leading = np.minimum(self.since[kinds], least(np.zeros(len(starts), np.int64), order[starts]))
        between[starts] = np.where(self.first[kinds], 0, leading + 1)
        place = self.head[sorted_byte] + np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
        self.suffix[place], self.prefix[place] = suffix[order], between
        ends = np.r_[starts[1:], n] - 1
        self.head[kinds] += ends - starts + 1
        self.since = np.minimum(self.since, prefix.min())
        after = order[ends] + 1
        open_ended = after < n
        self.since[kinds] = 255
        self.since[kinds[open_ended]] = least(after[open_ended], np.full(int(open_ended.sum()), n - 1))
        self.first[kinds] = False


def _oldest(age: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The least age of each row's group; groups are runs of equal numbers."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.repeat(np.minimum.reduceat(age, starts), np.diff(np.r_[starts, len(age)]))


def repeated_strings(columns: np.ndarray, age: np.ndarray, folder: str | None = None, shard: np.ndarray | None = None) -> np.ndarray:
    """(segments, REACH + 1) marks: from the k-th byte of a segment on, LENGTH bytes are those of an older segment.

    columns: (WIDTH, segments), a row for each place. age: smaller is earlier, equal for repeated rows. folder: for files.
    shard: numbers of shards that may have the same strings and are told apart.
    """
    n = columns.shape[1]
    marks = _array(folder, "marks", bool, (n, REACH + 1))
    suffix, prefix = _array(folder, "first-suffix", np.int32, n), _array(folder, "first-prefix", np.uint8, n)
    for at in range(0, n, BLOCK):
        suffix[at : at + BLOCK], prefix[at : at + BLOCK] = np.arange(at, min(n, at + BLOCK)), 0
    for place in range(WIDTH - 1, -1, -1):
        counts = np.zeros(256, np.int64)
        for at in range(0, n, BLOCK):
            counts += np.bincount(columns[place, at : at + BLOCK], minlength=256)
        queue = BucketQueue(counts, folder, f"{place % 2}")
        for at in range(0, n, BLOCK):
            own = np.asarray(suffix[at : at + BLOCK])
            queue.push(columns[place][own], own, np.asarray(prefix[at : at + BLOCK]))
        suffix, prefix = queue.suffix, queue.prefix
        if place <= REACH:
            at = 0
            while at < n:
                end = min(n, at + BLOCK)
                while end < n and prefix[end] >= LENGTH:  # never through a group of equal strings
                    end += 1
                own, group = np.asarray(suffix[at:end]), np.cumsum(np.asarray(prefix[at:end]) < LENGTH)
                if shard is not None:
                    group = group << 32 | shard[own]
                    by = np.argsort(group, kind="stable")
                    own, group = own[by], group[by]
                marks[own, place] = age[own] > _oldest(age[own], group)
                at = end
    return marks


def spans(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end) of the bytes that marked strings cover, a row for each run of marks."""
    padded = np.zeros((len(marks), marks.shape[1] + 2), np.int8)
    padded[:, 1:-1] = marks
    step = np.diff(padded, axis=1)
    segment, start = np.nonzero(step == 1)
    return segment, start, np.nonzero(step == -1)[1] - 1 + LENGTH


DOC = ["doc_id", "th"]
_FIRST = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _piece_counts(docs: DataFrame) -> DataFrame:
    """(piece, n) as each task saw them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, 512):
            found = [anchors(np.frombuffer((text or "").encode(), np.uint8))[1] for text in batch.column("text").to_pylist()]
            piece, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(piece.view(np.int64)), pa.array(n)], ["piece", "n"])

    return docs.select("text").mapInArrow(count, "piece long, n long")


def _bitmap(pieces: DataFrame) -> tuple[np.ndarray, int] | None:
    """Bits of the trailing places of all pieces, about 16 for each and at most 2 ** MOST_BITS; None if they would be too full
    to tell pieces apart. Its size is bounded whatever the input, and what it lets through by chance the join drops."""
    n = pieces.count()
    if n > 1 << MOST_BITS:
        return None
    bits = min(max(int(16 * n).bit_length(), 12), MOST_BITS)
    # the trailing places: anchors have the least hashes, so their leading places are alike
    word = F.shiftright(F.col("piece").bitwiseAND(F.lit((1 << bits) - 1)), 6)
    words = pieces.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(piece & 63 as int))")).alias("set"))
    found, bitmap = words.toArrow(), np.zeros(1 << (bits - 6), np.int64)
    bitmap[found["word"].to_numpy()] = found["set"].to_numpy()
    return bitmap.view(np.uint64), bits


def _segments(docs: DataFrame, bitmap: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(piece, class, doc_id, th, at) of every anchor whose piece may be in the bitmap."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap) if bitmap else None

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pieces, places, kinds, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                at, piece = anchors(np.frombuffer(data, np.uint8))
                if held is not None:
                    words, bits = held.value
                    place = piece & np.uint64((1 << bits) - 1)
                    kept = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
                    at, piece = at[kept], piece[kept]
                pieces.append(piece)
                places.append(at)
                sizes.append(len(at))
                # the place of the anchor in the segment is part of its class
                kinds += [xxhash.xxh64_intdigest(data[max(0, x - REACH) : x + LENGTH], min(x, REACH)) for x in at.tolist()]
            at, row = np.concatenate(places), pa.array(np.repeat(np.arange(len(sizes)), sizes))
            kind = np.array(kinds, np.uint64).view(np.int64)
            fields = [pa.array(np.concatenate(pieces).view(np.int64)), pa.array(kind), batch.column("doc_id").take(row), batch.column("th").take(row), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(fields, ["piece", "class", "doc_id", "th", "at"])

    return docs.mapInArrow(find, "piece long, class long, doc_id long, th long, at int")


def _with_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(piece, doc_id, th, at, before, segment) for wanted(piece, doc_id, th, at); a document's list is bounded by its length."""
    lists = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("piece", "at")).alias("places"))
    ours = lists.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), "places")
    joined = docs.join(ours, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))).select(*DOC, "text", "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.binary()]
        for batch in slices(batches):
            rows = []
            for doc_id, th, text, places in zip(*(batch.column(c).to_pylist() for c in (*DOC, "text", "places")), strict=True):
                data = text.encode()
                rows += [(p["piece"], doc_id, th, p["at"], min(p["at"], REACH), data[max(0, p["at"] - REACH) : p["at"] + LENGTH]) for p in places]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["piece", "doc_id", "th", "at", "before", "segment"])

    return joined.mapInArrow(cut, "piece long, doc_id long, th long, at int, before short, segment binary")


ROW = ["shard", "low", "high", *DOC, "at", "before", "segment"]


def _shards(rows: DataFrame) -> DataFrame:
    """Rows of _with_bytes as shards in which strings at all places, low to high, are looked for."""
    places = [F.lit(p).cast("short").alias(c) for p, c in ((0, "low"), (REACH, "high"))]
    return rows.select(F.col("piece").alias("shard"), *places, *DOC, "at", "before", "segment")


def _split(rows: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the same work in shards of at most ``crowd`` rows; spans are what shards of one place have found.

    All strings of a shard at places low to high hold the bytes from high to low + LENGTH, and the shard's rows agree there.
    """
    spare = REACH - F.col("before")  # the first place that a row's document reaches
    bytes_from = lambda place, n: F.substring(F.col("segment"), place - spare + 1, n)
    age, calm, found = F.struct(*DOC, "at"), None, None
    while True:
        rows = materialise(rows.select(*ROW), "crowds")
        hot = materialise(rows.groupBy("shard").count().filter(F.col("count") > crowd).select("shard"), "hot-shards")
        small = rows.join(hot, "shard", "left_anti").select(*ROW)
        calm = small if calm is None else calm.union(small)
        large = rows.join(hot, "shard", "left_semi")
        single = large.filter("low = high")
        first = single.groupBy("shard").agg(F.min(age).alias("first"))
        later = single.join(first, "shard").filter(~age.eqNullSafe(F.col("first")))
        start = (F.col("at") - REACH + F.col("low")).cast("long")
        spans_ = later.select(*DOC, start.alias("start"), (start + LENGTH).alias("end"))
        found = spans_ if found is None else found.union(spans_)
        if not hot.limit(1).count():
            return calm, found
        wide = large.filter("low < high").withColumn("middle", F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
        left_bytes = bytes_from(F.col("middle"), F.col("high") - F.col("middle"))
        left = wide.filter(spare <= F.col("middle")).withColumns({"shard": F.xxhash64("shard", F.lit(0), left_bytes), "high": F.col("middle").cast("short")})
        right_bytes = bytes_from(F.col("low") + LENGTH, F.col("middle") + 1 - F.col("low"))
        right = wide.filter(spare + F.length("segment") >= F.col("middle") + 1 + LENGTH)
        right = right.withColumns({"shard": F.xxhash64("shard", F.lit(1), right_bytes), "low": (F.col("middle") + 1).cast("short")})
        rows = left.select(*ROW).union(right.select(*ROW))


def _sort_shards(rows: DataFrame, in_memory: int = IN_MEMORY) -> DataFrame:
    """(doc_id, th, start, end) of strings in shards that an earlier segment has too."""

    def blocks(rows: pa.Table, size: int = 1 << 12) -> Iterator[tuple[slice, pa.Table]]:
        for low in range(0, rows.num_rows, size):
            part = rows.slice(low, size)
            yield slice(low, low + part.num_rows), part

    def order(rows: pa.Table, folder: str | None) -> Iterator[pa.RecordBatch]:
        """Spans of the segments of whole shards, which come by age; all arrays are files if there is a folder."""
        n = rows.num_rows
        columns, age = _array(folder, "text", np.uint8, (WIDTH, n)), _array(folder, "age", np.int32, n)
        number, last, oldest, alike = _array(folder, "shard", np.int64, n), None, 0, False
        for own, part in blocks(rows):
            segments, before = part["segment"].to_pylist(), part["before"].to_numpy()
            block = b"".join((b"\xff" * (REACH - b) + x).ljust(WIDTH, b"\xff") for b, x in zip(before.tolist(), segments, strict=True))
            columns[:, own] = np.frombuffer(block, np.uint8).reshape(-1, WIDTH).T
            key = np.stack([part["doc_id"].fill_null(_FIRST).to_numpy(), part["th"].to_numpy(), part["at"].to_numpy(), part["shard"].to_numpy()])
            new = np.r_[last is None or bool((key[:, 0] != last).any()), (key[:, 1:] != key[:, :-1]).any(axis=0)]
            firsts = np.maximum.accumulate(np.where(new, np.arange(own.start, own.stop), oldest))  # repeated rows of a document are one
            changed = np.r_[last is not None and key[3, 0] != last[3], key[3, 1:] != key[3, :-1]]
            number[own] = np.cumsum(changed) + (number[own.start - 1] if own.start else 0)
            age[own], last, oldest = firsts, key[:, -1], int(firsts[-1])
            alike = alike or bool(part["low"].to_numpy().any() or (part["high"].to_numpy() < REACH).any())
        marks = repeated_strings(columns, age, folder, number if alike else None)
        del columns
        place = np.arange(REACH + 1)[None, :]
        for own, part in blocks(rows, 1 << 16):
            lead = (REACH - part["before"].to_numpy())[:, None]
            size = pc.binary_length(part["segment"]).to_numpy()[:, None]
            low, high = part["low"].to_numpy()[:, None], part["high"].to_numpy()[:, None]
            # strings that reach outside of their document are no strings
            segment, start, end = spans(marks[own] & (place >= lead) & (place + LENGTH <= lead + size) & (place >= low) & (place <= high))
            base, row = part["at"].to_numpy()[segment].astype(np.int64) - REACH, pa.array(segment)
            ids = [pa.concat_arrays(part[c].take(row).chunks or [pa.array([], pa.int64())]) for c in DOC]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(base + start), pa.array(base + end)], [*DOC, "start", "end"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards together, in_memory segments or more; what is over twice that waits in a file."""
        held, size, spill, stack = [], 0, None, contextlib.ExitStack()

        def found() -> Iterator[pa.RecordBatch]:
            with stack:
                if spill is None:
                    yield from order(pa.Table.from_batches(held), None)
                else:
                    for batch in held:
                        spill[1].write_batch(batch)
                    spill[1].close()
                    yield from order(pa.ipc.open_file(stack.enter_context(pa.memory_map(f"{spill[0]}/rows"))).read_all(), spill[0])

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            last = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if size >= in_memory and (last or ending != shard[0]):
                held.append(batch.slice(0, last))
                yield from found()
                held, size, spill, stack, batch = [], 0, None, contextlib.ExitStack(), batch.slice(last)
            if batch.num_rows:
                held.append(batch)
                size, ending = size + batch.num_rows, shard[-1]
            if size > 2 * in_memory:
                if spill is None:
                    folder = stack.enter_context(tempfile.TemporaryDirectory())
                    spill = folder, pa.ipc.new_file(stack.enter_context(pa.OSFile(f"{folder}/rows", "wb")), batch.schema)
                for waiting in held:
                    spill[1].write_batch(waiting)
                held = []
        if size:
            yield from found()

    return rows.repartition("shard").sortWithinPartitions("shard", *DOC, "at").mapInArrow(sort, "doc_id long, th long, start long, end long")


def repeated_spans(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, start, end) of byte runs, overlapping ones among them, that strings seen earlier cover; ends may pass the text's."""
    docs = _keyed(docs).filter("text is not null")
    pieces = materialise(_piece_counts(docs).groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1").select("piece"), "pieces")
    segments = materialise(_segments(docs, _bitmap(pieces)).join(pieces, "piece"), "segments")
    place = F.struct(*DOC, "at")
    classes = materialise(segments.groupBy("piece", "class").agg(F.min(place).alias("first"), F.count("*").alias("n")), "segment-classes")
    copies = segments.join(classes.filter("n > 1").select("piece", "class", "first"), ["piece", "class"]).filter(~place.eqNullSafe(F.col("first")))
    whole = copies.select(*DOC, F.greatest(F.col("at") - REACH, F.lit(0)).cast("long").alias("start"), (F.col("at") + LENGTH).cast("long").alias("end"))
    kinds = materialise(classes.groupBy("piece").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "piece-kinds")

    def wanted(which: str) -> DataFrame:
        chosen = kinds.filter(which).select("piece")
        return _shards(_with_bytes(docs, classes.join(chosen, "piece").select("piece", "first.doc_id", "first.th", "first.at")))

    found = whole.union(_sort_shards(wanted(f"kinds <= {crowd}")))
    if kinds.filter(F.col("kinds") > crowd).limit(1).count():
        rows, single = _split(wanted(f"kinds > {crowd}"), crowd)
        found = found.union(_sort_shards(rows)).union(single)
    return found


def _merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal runs; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(zip(starts, ends, strict=True)):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


@keeps_columns("_n_bytes", "_n_removed", "_n_spans", "_kept_sha256")
def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The input's columns with text cut (a character that is cut through goes whole), and _n_bytes, _n_removed, _n_spans, _kept_sha256."""
    with temporary(docs.sparkSession) as result:
        found = result(repeated_spans(docs, crowd), "spans")
    lists = found.groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    lists = lists.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "_spans")
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_t")), "left").select(*(docs[c] for c in docs.columns), "_spans")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            texts, counts = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                data = (text or "").encode()
                runs = _merged([r["start"] for r in runs], [min(r["end"], len(data)) for r in runs]) if runs else []
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(data)], strict=True))
                texts.append(text if text is None or not runs else kept.decode(errors="ignore"))
                counts.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*counts, strict=True)) or [()] * 4
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True))], [*names, "_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(cut, f"{fields}, _n_bytes long, _n_removed long, _n_spans long, _kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.col("_kept_sha256").alias("kept_sha256"))
