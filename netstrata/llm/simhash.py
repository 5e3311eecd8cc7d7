"""SimHash near-duplicates: fingerprints, shards by equal parts, BK-trees within shards, components.

``fingerprints`` makes a 64-bit SimHash of word shingles. ``link_fingerprints`` finds all pairs of distinct fingerprints
within a small radius: of radius + 1 blocks of bits at least one is equal in both, so block values are shard keys, a
shard's tree is built by the task that holds it, and every task returns one edge for each item of a local component
rather than all pairs. A shard over ``HOT`` items is dealt again by the blocks of its remaining bits, which must again
agree in one place, so no link is lost, and so on until it is small.

``near_duplicates`` is the wider search of the pipeline stage: five-word shingles and a similarity of 0.8. A radius of 3
in 64 bits can't reach that similarity (it stands for about 10 differing bits, at which equal blocks no longer shard),
so 1024-bit fingerprints of the distinct shingles, sharded by minima of shingle hashes, choose candidates, and the sets of
shingle hashes decide; see its docstring.

Nulls and odd input: null, empty and blank texts have fingerprint zero and are linked like any other. A row with null
doc_id gets its component's smallest id (null where there is none), and links others. Equal rows keep one row each. Very long texts take memory in proportion in the
task that reads them. Empty tables give no rows. Other columns of the input are ignored (link functions) or kept
(near_duplicates).
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bktree
from .common import create, few, forget, keeps_columns, materialise, new_path, read_at, slices, table, temporary
from .graph import components

SEED = 42
RADIUS = 3
#: Items of a shard from which it is dealt again by further blocks.
HOT = 4096
#: Times that shards are dealt again at most; four blocks then have used up all but 20 bits.
DEALS = 4
#: Rows that a task searches together, when shards are small.
GATHER = 100_000
WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Unsigned XXH64 (seed 42) of each shingle of lower-cased words, in order; the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist(), strict=True)), np.uint64, n)


def bits_over_half(hashes: np.ndarray) -> np.ndarray:
    """(words,) fingerprint of (n, words) hashes: a bit is 1 if it is set in over half of the n."""
    n, words = hashes.shape
    total = np.zeros(64 * words, np.int64)
    for at in range(0, n, 4096):
        big = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8 * words)
        total += np.add.reduce(np.unpackbits(big, axis=1), axis=0, dtype=np.uint16)
    return np.packbits(2 * total > n).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and simhash (long with the fingerprint's 64 bits) of every whole text."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, shingle)
                prints.append(bits_over_half(hashes[:, None])[0] if len(hashes) else np.uint64(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "simhash"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, simhash long")


def _cut(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of parts of the bits low to high."""
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _block(column: str, first: int, width: int) -> F.Column:
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << width) - 1))


def _deal_again(rows: DataFrame, parts: int) -> DataFrame:
    """rows(shard, simhash, node, mask) once for each of so many equal parts of the bits in their mask: the shard is that of
    before and the part's value, and the mask loses the part."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, value, node, mask = (batch.column(c).to_numpy() for c in ("shard", "simhash", "node", "mask"))
            for own in np.unique(mask):
                at = np.flatnonzero(mask == own)
                bits = [1 << i for i in range(64) if int(own) >> i & 1]
                for j, (first, width) in enumerate(_cut(0, len(bits), parts)):
                    part = np.array([sum(bits[first : first + width])], np.uint64).view(np.int64)[0]
                    key = _mixed((shard[at] ^ np.int64(j + 1)).view(np.uint64), _ODD[:1])[:, 0] ^ _mixed((value[at] & part).view(np.uint64), _ODD[1:2])[:, 0]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value[at]), pa.array(node[at]), pa.array(np.full(len(at), own & ~part))], ["shard", "simhash", "node", "mask"])

    return rows.mapInArrow(deal, "shard long, simhash long, node long, mask long")


def _shards(prints: DataFrame, radius: int, hot: int) -> DataFrame:
    """(shard, simhash, node): each fingerprint under the value of each of radius + 1 blocks. Shards over ``hot`` rows are dealt
    again by the same number of parts of their remaining bits, one of which must agree as well, until they are small."""
    blocks = _cut(0, 64, radius + 1)
    masks = [np.array([2**64 - 1 - ((1 << width) - 1 << first)], np.uint64).view(np.int64)[0] for first, width in blocks]
    keys = F.array(*(F.struct(F.xxhash64(F.lit(i), _block("simhash", *b)).alias("shard"), F.lit(int(m)).alias("mask")) for i, (b, m) in enumerate(zip(blocks, masks, strict=True))))
    dealt = prints.select("simhash", "node", F.explode(keys).alias("k")).select("k.shard", "simhash", "node", "k.mask")
    done = []
    for _ in range(DEALS):
        crowded = materialise(dealt.groupBy("shard").count().filter(F.col("count") > hot).select("shard"), "crowded-shards")
        if not crowded.limit(1).count():
            break
        done.append(dealt.join(crowded, "shard", "left_anti"))
        dealt = materialise(_deal_again(dealt.join(crowded, "shard", "left_semi"), radius + 1), "dealt-again")
    return reduce(DataFrame.union, [*done, dealt]).select("shard", "simhash", "node")


def _local_edges(shards: DataFrame, words: int, link) -> DataFrame:
    """Edges (a, b) from each item to the first of its component in its shard; link(table of sorted columns) -> first indices.

    A partition is read in order of shard; shards are searched together until GATHER rows are at hand.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            first, node = link(rows), rows["node"].to_numpy()
            moved = first != np.arange(len(first))
            return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[first[moved]])], ["a", "b"])

        held, size = [], 0
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            last = int(np.searchsorted(shard, shard[-1])) if batch.num_rows else 0
            if size >= GATHER and (last or held[-1].column("shard")[-1].as_py() != shard[0]):
                yield found([*held, batch.slice(0, last)])
                held, size, batch = [], 0, batch.slice(last)
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield found(held)

    return shards.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(search, "a long, b long")


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect nodes of prints(node long, simhash long), distinct in both, as links within the radius do."""

    def link(rows: pa.Table) -> np.ndarray:
        return bktree.components(rows["shard"].to_numpy(), rows["simhash"].to_numpy().view(np.uint64)[:, None], radius)

    return _local_edges(_shards(prints, radius, hot), 1, link).distinct()


def similar_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, simhash, component_id: the smallest doc_id that links within the radius lead to. Fingerprints themselves are the
    nodes, so those that only rows without an id have link others as well."""
    with temporary(prints.sparkSession) as result:
        classes = materialise(prints.groupBy("simhash").agg(F.min("doc_id").alias("first")), "classes")
        found = components(link_fingerprints(classes.select("simhash", F.col("simhash").alias("node")), radius))
        grouped = classes.join(found, classes["simhash"] == found["node"], "left").select("simhash", "first", F.coalesce("component", "simhash").alias("component"))
        grouped = materialise(grouped, "grouped")
        least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
        named = result(grouped.join(least, "component").select("simhash", "component_id"), "components")
    return prints.join(named, "simhash", "left")


WIDE_WORDS = 16
SHINGLE, SIMILARITY = 5, 0.8
KEYS = 8
#: Standard errors of the wide fingerprint's distance that a candidate is allowed beyond a pair at the similarity; sets of
#: fewer shingles than FEW, whose fingerprints say little, are candidates at every distance.
ALLOWED_ERRORS = 4.5
FEW = 32
#: Bytes of shingle hashes that a task remembers while it compares sets.
HELD_SETS = 64 << 20
#: Rounds in which leaders thin shards over the hot size.
ROUNDS = 4
MEMBER = ["shard", "node", "print", "n_shingles", "file", "place"]
CROWDED = 512
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) + 0x632BE59BD9B4E019 * i) % 2**64 | 1 for i in range(WIDE_WORDS + KEYS)], np.uint64)


def _mixed(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(n, factors) further hashes of each hash."""
    out = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(29))) * factors[None, :]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(31))


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), print (binary, 64 * WIDE_WORDS bits over the distinct shingles), n_shingles, keys (minima of
    KEYS hashes), digest of the set of shingle hashes, and the file and place in it at which the task wrote the set, sorted."""
    folder = new_path(docs.sparkSession, "shingle-sets")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        path = f"{folder}/{uuid.uuid4().hex}"
        with create(path) as out:
            for batch in slices(batches):
                prints, sizes, keys, digests, places = [], [], [], [], []
                for text in batch.column("text").to_pylist():
                    hashes = np.unique(shingle_hashes(text, SHINGLE))
                    if len(hashes):
                        parts = [_mixed(hashes[at : at + 4096], _ODD) for at in range(0, len(hashes), 4096)]
                        prints.append(_majority([p[:, :WIDE_WORDS] for p in parts], len(hashes)))
                        keys.append(np.min([p[:, WIDE_WORDS:].min(axis=0) for p in parts], axis=0).view(np.int64))
                    else:
                        prints.append(bytes(8 * WIDE_WORDS))
                        keys.append(np.zeros(KEYS, np.int64))
                    sizes.append(len(hashes))
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    places.append(out.tell())
                    out.write(hashes.tobytes())
                out.flush()  # before the rows that name the places
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * KEYS), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
                columns = [batch.column("doc_id"), batch.column("th"), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), lists]
                columns += [pa.array(digests, pa.binary()), pa.array([path] * len(keys), pa.string()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "print", "n_shingles", "keys", "digest", "file", "place"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return narrow.mapInArrow(make, "doc_id long, th long, print binary, n_shingles long, keys array<long>, digest binary, file string, place long")


class ShingleSets:
    """Exact similarity of the sets of rows(file, place, n_shingles), read where tasks wrote them."""

    def __init__(self, rows: pa.Table):
        self.file, self.place, self.size = rows["file"].to_pylist(), rows["place"].to_pylist(), rows["n_shingles"].to_numpy()
        self.held: OrderedDict[tuple[str, int, int], np.ndarray] = OrderedDict()
        self.bytes = 0

    def hashes(self, row: int) -> np.ndarray:
        key = self.file[row], self.place[row], 8 * int(self.size[row])  # an empty set has the place of the next
        if key not in self.held:
            self.held[key] = np.frombuffer(read_at(*key), np.uint64)
            self.bytes += self.held[key].nbytes
            while self.bytes > HELD_SETS and len(self.held) > 2:
                self.bytes -= self.held.popitem(last=False)[1].nbytes
        self.held.move_to_end(key)
        return self.held[key]

    def similar(self, a: np.ndarray, b: np.ndarray, fifths: int = 4) -> np.ndarray:
        """Whether shared shingles are at least so many fifths of all shingles of each a and b."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        out = 5 * small >= fifths * large
        for i in np.flatnonzero(out):
            both = np.sort(np.concatenate([self.hashes(int(a[i])), self.hashes(int(b[i]))]), kind="stable")
            out[i] = (5 + fifths) * np.count_nonzero(both[1:] == both[:-1]) >= fifths * len(both)
        return out


def _majority(parts: list[np.ndarray], n: int) -> bytes:
    total = np.zeros(64 * WIDE_WORDS, np.int64)
    for part in parts:
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1)
        total += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(2 * total > n).tobytes()


def farthest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits up to which sets of a and b shingles may be of the similarity: the cosine that the similarity means for
    these sizes, the share of bits that its angle gives, bits at a tie, and the allowed errors. Below 0: sizes too far apart."""
    a, b = np.maximum(a, 1).astype(float), np.maximum(b, 1).astype(float)
    cosine = SIMILARITY * (a + b) / ((1 + SIMILARITY) * np.sqrt(a * b))
    share = np.minimum(np.arccos(np.minimum(cosine, 1.0)) / np.pi + np.sqrt(0.5 / np.pi / np.minimum(a, b)), 0.5)
    bits = 64 * WIDE_WORDS
    reach = bits * share + ALLOWED_ERRORS * np.sqrt(bits * share * (1 - share))
    reach = np.where(np.minimum(a, b) < FEW, bits, reach)
    return np.where(np.minimum(a, b) >= SIMILARITY * np.maximum(a, b), reach, -1)


def _parts(n: F.Column, hot: int) -> F.Column:
    return F.ceil(n / F.lit(max(1, hot // 2)))


def _in_pairs(rows: DataFrame, hot: int) -> DataFrame:
    """Rows of each shard in shards of about ``hot`` rows, at least one of which holds any two of them: pairs of parts."""
    counted = rows.join(few(materialise(rows.groupBy("shard").agg(_parts(F.count("*"), hot).alias("parts")), "parts")), "shard")
    own = counted.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter("other <> own or parts = 1")
    return other.withColumn("shard", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))).select(*MEMBER)


def _across(judged: DataFrame, turn: int, hot: int) -> DataFrame:
    """Followers and the rows that may be near to one, in shards of about ``hot`` rows that bring each two of them together."""
    count = lambda role: F.count(F.when(F.col("role") == role, 1))
    sizes = judged.groupBy("shard").agg(_parts(count(1), hot).alias("between"), _parts(count(2), hot).alias("followers")).filter("between > 0")
    both = judged.filter("role > 0").join(few(materialise(sizes, "parts")), "shard")
    mine, theirs = (F.when(F.col("role") == role, F.col("between")).otherwise(F.col("followers")) for role in (1, 2))
    both = both.withColumns({"own": F.pmod(F.xxhash64("node", F.lit(1)), mine), "other": F.explode(F.sequence(F.lit(0).cast("long"), theirs - 1))})
    first = F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("role") == 1, F.col("other")).otherwise(F.col("own"))
    return both.withColumn("shard", F.xxhash64("shard", F.lit(turn), first, second)).select(*MEMBER)


def _judged(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Members with their shard's leader and a role: 2 similar to it (a follower), 1 near enough to be similar to a follower, 0.

    1 - similarity is a metric, so what is similar to a follower (0.8) is of similarity 0.6 or more to the leader.
    """
    names = [*MEMBER, "leader", "role"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            n, rows = batch.num_rows, pa.Table.from_batches([batch])
            own = rows.select(["file", "place", "n_shingles"])
            sets = ShingleSets(pa.concat_tables([own, rows.select(["leader_file", "leader_place", "leader_n"]).rename_columns(own.column_names)]))
            role, at = np.zeros(n, np.int64), np.arange(n)
            for fifths in (3, 4):
                at = at[sets.similar(at, at + n, fifths)]
                role[at] += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(role)], names)

    kinds = ", ".join(f"{c} {t}" for c, t in members.select(*MEMBER).dtypes)
    return members.join(few(leaders), "shard").mapInArrow(judge, f"{kinds}, leader long, role long")


def _thinned(members: DataFrame, hot: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(edges, rows to search) of shards over ``hot`` rows, no shard of which is one task's: in each round a leader of every
    such shard takes the members similar to it out, after these are brought together with what may be near to them; what
    then is over ``hot`` still is searched in pairs of parts."""
    edges, rows = [], []
    for turn in range(ROUNDS):
        sizes = materialise(members.groupBy("shard").count().filter(F.col("count") > hot), "crowded-shards")
        leader = F.min_by(F.struct(F.col("node").alias("leader"), F.col("file").alias("leader_file"), F.col("place").alias("leader_place"), F.col("n_shingles").alias("leader_n")), F.struct(F.xxhash64("node", F.lit(turn)), "node"))
        leaders = materialise(members.join(few(sizes), "shard", "left_semi").groupBy("shard").agg(leader.alias("l")).select("shard", "l.*"), "leaders")
        if not leaders.limit(1).count():
            break
        judged = materialise(_judged(members, leaders), "judged")
        edges.append(judged.filter("role = 2 and node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
        rows.append(_across(judged, turn, hot))
        rows.append(members.join(few(leaders), "shard", "left_anti").select(*MEMBER))
        members = judged.filter("role < 2").select(*MEMBER)
    return edges, [*rows, _in_pairs(members, hot)]


def near_duplicate_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, th, component_id) of all documents with an id: groups linked by a similarity of 0.8 or more of five-word shingles.

    Equal sets are one item. Items that share the minimum of one of eight hashes are a shard (two documents at the
    similarity share none with a chance of 0.2 ** 8); shards over ``hot`` items are thinned by leaders and split over tasks.
    Fingerprints only choose candidates: a link needs the similarity of the two sets of shingle hashes themselves. Crowds
    of near copies in a shard are clustered around leaders before BK-trees search the rest.
    """
    made = materialise(wide_fingerprints(docs.filter("doc_id is not null")), "wide-prints")
    # equal sets have equal keys, so a class keeps what any of its documents has
    first = F.min_by(F.struct("print", "keys", "file", "place"), "doc_id").alias("first")
    classes = materialise(made.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("node"), first).select("digest", "n_shingles", "node", "first.*"), "print-classes")
    dealt = classes.select("node", F.posexplode("keys").alias("i", "key"))
    sizes = materialise(dealt.groupBy("i", "key").count().filter("count > 1"), "shards")
    members = classes.select("node", "print", "n_shingles", "file", "place")

    def shards(which: F.Column) -> DataFrame:
        return dealt.join(sizes.filter(which), ["i", "key"]).select(F.xxhash64("i", "key").alias("shard"), "node").join(members, "node").select(*MEMBER)

    edges, rows = [], [shards(F.col("count") <= hot)]
    if sizes.filter(F.col("count") > hot).limit(1).count():
        edges, more = _thinned(materialise(shards(F.col("count") > hot), "crowds"), hot)
        rows += more
    searched = _local_edges(reduce(DataFrame.union, rows), WIDE_WORDS, link_sets)
    found = components(reduce(DataFrame.union, edges, searched).distinct())
    named = classes.join(found, "node", "left").select("digest", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return made.join(named, ["digest", "n_shingles"]).select("doc_id", "th", "component_id")


def link_sets(rows: pa.Table) -> np.ndarray:
    """First row of each row's component under links of the similarity, shard by shard."""
    prints = np.frombuffer(b"".join(rows["print"].to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
    size, sets = rows["n_shingles"].to_numpy(), ShingleSets(rows)
    reach = np.ceil(farthest(np.ceil(size * SIMILARITY), np.ceil(size * SIMILARITY))).astype(np.int64)

    def accept(a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> np.ndarray:
        kept = distance <= farthest(size[a], size[b])
        kept[kept] = sets.similar(a[kept], b[kept])
        return kept

    return bktree.components(rows["shard"].to_numpy(), prints, reach, accept, CROWDED)


@keeps_columns()
def near_duplicates(docs: DataFrame) -> DataFrame:
    """The input's rows without those that are near copies of one with a smaller doc_id; of equal rows one stays, and rows
    without a doc_id all stay. Different texts under one doc_id are one member of a group."""
    with temporary(docs.sparkSession) as result:
        groups = near_duplicate_groups(docs).filter("doc_id = component_id")
        kept = result(groups.groupBy("doc_id", "th").agg(F.count("*").alias("_n")), "kept")

    def rows(which: str) -> DataFrame:
        ids = kept.filter(which).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
        return docs.join(ids, (docs["doc_id"] == F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th")), "left_semi")

    out = docs.filter("doc_id is null").union(rows("_n = 1"))
    if kept.filter("_n > 1").limit(1).count():
        out = out.union(rows("_n > 1").dropDuplicates(["doc_id", "text"]))
    return out


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialise(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return similar_groups(prints).select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
