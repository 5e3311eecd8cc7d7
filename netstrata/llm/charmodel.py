"""Character language models in sorted hash arrays.

Texts are cut into units (a word, a URL); a unit is scored between a start and an end mark, with at most ``order - 1``
characters before each. Counts come from Spark as (label, gram, n), the gram being a character with its longest context.
``kneser_ney`` and ``witten_bell`` smooth them by joins and aggregates over all grams, into log probabilities of all labels
for every known gram, and weights to back off from every known context; each length is a sorted array of 64-bit hashes
beside a matrix with a column per label. Arrays of at most ``MOST_BYTES`` are collected and broadcast. Larger ones stay in
sorted files of the shared folder, which must be mounted then, and workers map them; the driver holds a row for each file.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_path, materialise, new_path

START, END = "\x02", "\x03"
#: Largest table that goes through the driver.
MOST_BYTES = 32 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(unit: str, order: int) -> list[str]:
    """Each character of the unit, and the end mark, with its longest context."""
    marked = START + unit + END
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def _fold(codes: np.ndarray, have: np.ndarray) -> np.ndarray:
    return (have ^ codes) * _MIX + (have >> np.uint64(29))


def hashes(texts: list[str]) -> np.ndarray:
    """64-bit hash of each string, from its last character backwards."""
    out = np.zeros(len(texts), np.uint64)
    by_length = defaultdict(list)
    for i, t in enumerate(texts):
        by_length[len(t)].append(i)
    for n, rows in by_length.items():
        if n:
            codes = np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)
            value = np.zeros(len(rows), np.uint64)
            for k in range(n - 1, -1, -1):
                value = _fold(codes[:, k], value)
            out[rows] = value
    return out


class HashTable:
    """Rows of numbers by sorted key, in memory."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the rows of those."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), self.values
        where = np.searchsorted(self.keys, keys)
        where[where == len(self.keys)] = 0
        found = self.keys[where] == keys
        return found, self.values[where[found]]


class HashFiles:
    """The same in files, each a sorted run of keys and then their rows, mapped when first asked."""

    def __init__(self, runs: list[tuple[int, int, str]], width: int):
        """runs: (first key, keys, path), in order of keys."""
        self.first, self.runs, self.width = np.array([r[0] for r in runs], np.uint64), runs, width
        self.mapped: dict[int, HashTable] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def __len__(self) -> int:
        return sum(n for _, n, _ in self.runs)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, values = np.zeros(len(keys), bool), np.zeros((len(keys), self.width))
        run = np.searchsorted(self.first, keys, side="right") - 1
        for i in np.unique(run[run >= 0]).tolist():
            if i not in self.mapped:
                _, n, path = self.runs[i]
                table = HashTable.__new__(HashTable)
                table.keys = np.memmap(path, np.uint64, "r", shape=(n,))
                table.values = np.memmap(path, np.float64, "r", offset=8 * n, shape=(n, self.width))
                self.mapped[i] = table
            own = np.flatnonzero(run == i)
            hit, rows = self.mapped[i].find(keys[own])
            found[own[hit]], values[own[hit]] = True, rows
        return found, values[found]


@dataclass
class Model:
    labels: list[str]
    order: int
    floor: np.ndarray  # log probability of an unknown character, per label
    known: list[HashTable | HashFiles]  # by gram length - 1: log probabilities
    backoff: list[HashTable | HashFiles]  # by context length: log weights

    def score(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units, labels) sums of log probabilities, and the number of characters with the end mark."""
        sizes = np.array([len(u) + 1 for u in units], np.int64)
        codes = np.frombuffer((START + (END + START).join(units) + END).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        inner = np.ones(len(codes), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        depth = at - np.repeat(starts, sizes)  # characters before, the start mark among them
        value = np.zeros((self.order, len(at)), np.uint64)
        context = np.zeros((self.order, len(at)), np.uint64)
        value[0] = _fold(codes[at], np.zeros(len(at), np.uint64))
        for k in range(1, self.order):
            before = codes[np.maximum(at - k, 0)]
            value[k], context[k] = _fold(before, value[k - 1]), _fold(before, context[k - 1])
        out = np.zeros((len(at), len(self.labels)))
        level = np.minimum(depth, self.order - 1)
        left = np.arange(len(at))
        for k in range(self.order - 1, -1, -1):
            own = left[level[left] >= k]
            found, rows = self.known[k].find(value[k][own])
            out[own[found]] += rows
            missed = own[~found]
            if k:
                seen, rows = self.backoff[k].find(context[k][missed])
                out[missed[seen]] += rows
            else:
                out[missed] += self.floor
            left = np.concatenate([left[level[left] < k], missed])
        return np.add.reduceat(out, np.cumsum(sizes) - sizes, axis=0) if len(units) else out, sizes


def _vector(items) -> Column:
    return F.array(*items)


def _suffixes(name: str) -> Column:
    """(cut, suffix) pairs: what is left of a gram without its first 0, 1, ... characters."""
    return F.posexplode(F.transform(F.sequence(F.lit(1), F.length(name)), lambda at: F.substr(F.col(name), at)))


def _by_label(counts: DataFrame, labels: list[str]) -> DataFrame:
    """(n array<double> by label, cut, gram) of every suffix of every counted gram."""
    own = counts.groupBy("gram").agg(_vector(F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).cast("double") for label in labels).alias("n"))
    return own.select("n", _suffixes("gram").alias("cut", "gram"))


def kneser_ney_counts(counts: DataFrame, labels: list[str]) -> DataFrame:
    """(gram, n) of grams of all lengths: of the longest, and of those that begin at the start mark, how often they stand; of
    the others how many different characters stand before them."""
    columns = range(len(labels))
    own = [F.sum(F.when(F.col("cut") == 0, F.col("n")[i]).otherwise(0.0)) for i in columns]
    seen = [F.max((F.col("n")[i] > 0).cast("double")) for i in columns]
    parts = materialise(_by_label(counts, labels).groupBy("gram").agg(_vector(own).alias("own"), _vector(seen).alias("seen")), "gram-suffixes")
    shorter = F.substr(F.col("gram"), F.lit(2)).alias("gram")
    before = parts.filter(F.length("gram") > 1).groupBy(shorter).agg(_vector(F.sum(F.col("seen")[i]) for i in columns).alias("before"))
    n = _vector(F.col("own")[i] + F.coalesce(F.col("before")[i], F.lit(0.0)) for i in columns)
    return parts.join(before, "gram", "left").select("gram", n.alias("n"))


def witten_bell_counts(counts: DataFrame, labels: list[str], fewest: int = 1) -> DataFrame:
    """(gram, n) of grams of all lengths; what a label has under ``fewest`` times is known by its shorter contexts alone."""
    sums = _by_label(counts, labels).groupBy("gram").agg(_vector(F.sum(F.col("n")[i]) for i in range(len(labels))).alias("n"))
    often = F.transform("n", lambda n: F.when((n >= fewest) | (F.length("gram") == 1), n).otherwise(0.0))
    return sums.select("gram", often.alias("n")).filter(F.exists("n", lambda n: n > 0))


def smoothed(levels: DataFrame, order: int, labels: list[str], discount: float | None) -> Model:
    """The model of levels(gram, n). discount: absolute discounting (Kneser-Ney); None: Witten-Bell.

    A gram's probability is a share of its own count and, with the weight of its context, the probability of the gram without
    its first character, down to a uniform one; so it is a sum over the gram's suffixes, which one join brings together.
    """
    columns = range(len(labels))
    levels = materialise(levels, "gram-levels")
    alphabet = levels.filter(F.length("gram") == 1).count() + 1
    rows = levels.select("gram", F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1).alias("context"), "n")
    sums = rows.groupBy("context").agg(_vector(F.sum(F.col("n")[i]) for i in columns).alias("total"), _vector(F.sum((F.col("n")[i] > 0).cast("double")) for i in columns).alias("types"))
    total, types = (lambda i: F.col("total")[i]), (lambda i: F.col("types")[i])
    whole = total if discount is not None else lambda i: total(i) + types(i)
    weight = [F.when(total(i) > 0, types(i) * (1.0 if discount is None else discount) / whole(i)).otherwise(1.0) for i in columns]
    contexts = materialise(sums.select("context", _vector(whole(i) for i in columns).alias("whole"), _vector(weight).alias("weight")), "gram-contexts")
    own = [F.when(F.col("whole")[i] > 0, F.greatest(F.col("n")[i] - (discount or 0.0), F.lit(0.0)) / F.col("whole")[i]).otherwise(0.0) for i in columns]
    terms = materialise(rows.join(contexts, "context").select("gram", _vector(own).alias("own"), "weight"), "gram-terms")
    chain = terms.select("gram", _suffixes("gram").alias("cut", "suffix")).join(terms.withColumnRenamed("gram", "suffix"), "suffix")
    steps = chain.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("cut", "own", "weight")), asc=False).alias("steps"))
    uniform = _vector(F.lit(1.0 / alphabet) for _ in columns)
    chance = F.aggregate("steps", uniform, lambda p, step: _vector(step["own"][i] + step["weight"][i] * p[i] for i in columns))
    root = contexts.filter("context = ''").first()
    floor = np.log(np.array(root["weight"] if root else [1.0] * len(labels)) / alphabet)
    log = lambda c: F.transform(c, lambda x: F.log(x))
    known = _tables(steps.select(F.col("gram").alias("text"), log(chance).alias("p")), range(1, order + 1), len(labels))
    return Model(labels, order, floor, known, _tables(contexts.select(F.col("context").alias("text"), log(F.col("weight")).alias("p")), range(order), len(labels)))


def _tables(rows: DataFrame, sizes: range, width: int) -> list[HashTable | HashFiles]:
    """A table for each of the sizes of rows(text, p array<double>)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = pa.array(np.fromiter(map(len, texts), np.int32, len(texts)))
            yield pa.RecordBatch.from_arrays([size, pa.array(hashes(texts).view(np.int64)), batch.column("p")], ["size", "hash", "p"])

    rows = materialise(rows.mapInArrow(hashed, "size int, hash long, p array<double>"), "model")
    if rows.count() * 8 * (width + 1) <= MOST_BYTES:
        found = rows.toArrow().combine_chunks()
        size, keys = found["size"].to_numpy(), found["hash"].to_numpy().view(np.uint64)
        values = found["p"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(keys) else np.zeros((0, width))
        return [HashTable(keys[size == n], values[size == n]) for n in sizes]
    folder = local_path(new_path(rows.sparkSession, "model-runs"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A file for each size among the task's rows, which are a range of (size, key)."""
        os.makedirs(folder, exist_ok=True)
        whole = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], pa.schema([("size", pa.int32()), ("hash", pa.int64()), ("p", pa.list_(pa.float64()))]))])
        size, runs = whole["size"].to_numpy(), []
        for n in np.unique(size).tolist():
            own, path = whole.filter(pa.array(size == n)), f"{folder}/{uuid.uuid4().hex}"
            keys = own["hash"].to_numpy().view(np.uint64)
            with open(path, "wb") as out:
                out.write(keys.tobytes())
                out.write(np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in own["p"].chunks]).tobytes())
            runs.append((n, keys[:1].view(np.int64)[0], len(keys), path))
        columns = list(zip(*runs, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["size", "first", "n", "path"])

    unsigned = F.col("hash").bitwiseXOR(F.lit(-(2**63)))
    sorted_rows = rows.repartitionByRange("size", unsigned).sortWithinPartitions("size", unsigned)
    runs = sorted_rows.mapInArrow(write, "size int, first long, n long, path string").collect()
    of = lambda n: sorted((r["first"] % 2**64, r["n"], r["path"]) for r in runs if r["size"] == n)
    return [HashFiles(of(n), width) for n in sizes]


def kneser_ney(counts: DataFrame, order: int, labels: list[str], discount: float = 0.75) -> Model:
    """Interpolated Kneser-Ney of counts(label, gram, n)."""
    return smoothed(kneser_ney_counts(counts, labels), order, labels, discount)


def witten_bell(counts: DataFrame, order: int, labels: list[str], fewest: int = 1) -> Model:
    """Interpolated Witten-Bell smoothing over contexts of every length, each used by a label that has it ``fewest`` times."""
    return smoothed(witten_bell_counts(counts, labels, fewest), order, labels, None)


def count_units(units: Counter, order: int) -> Counter:
    """Counts of (label, gram) from counts of (label, unit)."""
    out: Counter = Counter()
    for (label, unit), n in units.items():
        for gram in grams(unit, order):
            out[label, gram] += n
    return out
