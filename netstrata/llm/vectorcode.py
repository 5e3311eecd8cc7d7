"""Vector code compression: each vector as one index a part into codebooks that rounds of Lloyd's algorithm fit.

Vectors become integers, are cut into equal consecutive parts, and each part position has its codebook. All distances that
decide are integers. ``fit`` runs Yinyang rounds: a codebook's entries are clustered into groups once, a row keeps for each
part its entry, an upper bound of the distance to it and one lower bound for each group; when entries have moved, bounds
drift with them, and only groups whose bound fails are scanned, with whole integer distances, so ties go to the lower index.
A row's state travels with it as a table in the shared folder, of which the last one only is kept; sums of a round are
aggregates by part and entry, and the driver sees entries only (parts x entries x width integers).

Nulls and odd input: rows whose vector is null or holds null or non-finite components are dropped, and so are those whose
length differs from the vector of the smallest id among vectors that can be cut into parts. Rows without a vec_id are kept,
and come last where starting entries are chosen; of one id, smaller vectors come first. With fewer rows than entries each is
an entry. Repeated rows keep their rows. Integers beyond 2^63 count as that; errors beyond it are given as 2^63 - 1. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, forget, materialise, new_path, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Groups of entries, of which each row has a lower bound for each part.
GROUPS = 4
#: Up to this size of a component squared distances of 8,000 components fit 64 bits; beyond it Python's integers are used.
SMALL = 1 << 24
MOST = (1 << 63) - 1
#: Labels up to which their sums are broadcast (16 bytes each).
FEW_LABELS = 50_000
Codebooks = list[np.ndarray]  # for each part (entries, width)


@dataclass
class Codes:
    """rows: vec_id, label, codes array<int>, error long; codebooks: the final entries by part."""

    rows: DataFrame
    codebooks: Codebooks

    def sha256(self) -> str:
        """Of all entries' decimal integers by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints, floor(scale * x) of every component, of the rows whose components are all finite numbers."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", "label", ints.alias("ints"))


def _safe(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if sums of squares of their differences fit 64 bits, else with Python's integers."""
    if all(a.dtype != object and a.max(initial=0) <= SMALL and a.min(initial=0) >= -SMALL for a in arrays):
        return list(arrays)
    return [a.astype(object) for a in arrays]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) whole squared distances of (rows, width) to (entries, width)."""
    x, entries = _safe(x, entries)
    out = np.empty((len(x), len(entries)), x.dtype)
    for j, entry in enumerate(entries):
        gap = x - entry
        out[:, j] = (gap * gap).sum(axis=1)
    return out


def _roots(whole: np.ndarray) -> np.ndarray:
    return np.sqrt(whole.astype(np.float64))


def _down(bound: np.ndarray) -> np.ndarray:
    """As a 32-bit float that isn't larger."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def _up(bound: np.ndarray) -> np.ndarray:
    return np.nextafter(bound.astype(np.float32), np.float32(np.inf))


def entry_groups(book: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry: a few rounds of Lloyd's algorithm over the entries themselves, from evenly spaced ones."""
    points = book.astype(np.float64)
    groups = max(1, min(groups, len(points)))
    centres = points[np.arange(groups) * len(points) // groups]
    for _ in range(rounds):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(groups)])
    return own


def first_codes(x: np.ndarray, book: np.ndarray, own: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, upper, lower by group) by a scan of all entries."""
    whole = squares(x, book)
    codes = np.asarray(whole.argmin(axis=1), np.int64)
    at = np.arange(len(x))
    upper = _up(_roots(whole[at, codes]))
    far = _roots(whole)
    far[at, codes] = np.inf
    lower = np.full((len(x), groups), np.inf, np.float32)
    for g in range(groups):
        if (own == g).any():
            lower[:, g] = _down(far[:, own == g].min(axis=1))
    return codes, upper, lower


def next_codes(x: np.ndarray, book: np.ndarray, before: np.ndarray, own: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(codes, upper, lower, distances made) after entries moved from ``before`` to ``book``.

    A group is scanned if its bound, less the farthest move of its entries, isn't above the row's distance to its entry: an
    entry of another group is farther in truth, and can't tie. An entry that is left counts for its group's bound.
    """
    move = _up(_roots(np.array([((a.astype(object) - b.astype(object)) ** 2).sum() for a, b in zip(book, before, strict=True)], object)))
    groups, codes = lower.shape[1], codes.copy()
    drift = np.array([move[own == g].max(initial=0) for g in range(groups)], np.float32)
    upper, lower = _up(upper.astype(np.float64) + move[codes]), _down(lower.astype(np.float64) - drift)
    at = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    if not len(at):
        return codes, upper, lower, 0
    near = x[at]
    best = np.empty(len(at), object if near.dtype == object or book.dtype == object else np.int64)
    for j in np.unique(codes[at]):
        mine = codes[at] == j
        found = squares(near[mine], book[j : j + 1])[:, 0]
        best = best.astype(object) if found.dtype == object else best
        best[mine] = found
    start, held, made = codes[at].copy(), _roots(best), len(at)
    failed = lower[at] <= _up(held)[:, None]
    pick = start.copy()
    scanned: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    for g in range(groups):
        rows, entries = np.flatnonzero(failed[:, g]), np.flatnonzero(own == g)
        if not len(rows) or not len(entries):
            continue
        whole = squares(near[rows], book[entries])
        made += whole.size
        first = np.asarray(whole.argmin(axis=1), np.int64)
        least, name = whole[np.arange(len(rows)), first], entries[first]
        closer = (least < best[rows]) | ((least == best[rows]) & (name < pick[rows]))
        closer = closer.astype(bool)
        best = best.astype(object) if least.dtype == object else best
        best[rows[closer]], pick[rows[closer]] = least[closer], name[closer]
        scanned.append((g, rows, entries, whole))
    bounds = lower[at]
    moved = np.flatnonzero(pick != start)
    left = own[start[moved]]  # the group of an entry that is no longer the row's
    bounds[moved, left] = np.minimum(bounds[moved, left], _down(held[moved]))
    for g, rows, entries, whole in scanned:
        far = _roots(whole)
        far[entries[None, :] == pick[rows][:, None]] = np.inf
        bounds[rows, g] = _down(far.min(axis=1))
    codes[at], upper[at], lower[at] = pick, _up(_roots(best)), bounds
    return codes, upper, lower, made


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """(rows, n) as lists of n."""
    ends = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _assigned(state: DataFrame, books: Codebooks, before: Codebooks | None, own: list[np.ndarray], groups: int, last: bool) -> DataFrame:
    """State with codes (and bounds, or the error after the last round) for the codebooks as they are now."""
    parts, kinds = len(books), dict(state.dtypes)
    ids = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    schema = f"{ids}, codes array<int>, error long" if last else f"{ids}, ints array<bigint>, codes array<int>, bounds array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            n = batch.num_rows
            x = _matrix(batch.column("ints"), n).reshape(n, parts, -1)
            codes, bounds = np.empty((n, parts), np.int64), np.empty((n, parts, 1 + groups), np.float32)
            if before is not None:
                held, kept = _matrix(batch.column("codes"), n), _matrix(batch.column("bounds"), n).reshape(n, parts, -1)
            for p in range(parts):
                part = np.ascontiguousarray(x[:, p])
                if before is None:
                    codes[:, p], bounds[:, p, 0], bounds[:, p, 1:] = first_codes(part, books[p], own[p], groups)
                else:
                    codes[:, p], bounds[:, p, 0], bounds[:, p, 1:], _ = next_codes(part, books[p], before[p], own[p], held[:, p].astype(np.int64), kept[:, p, 0], kept[:, p, 1:])
            out = [batch.column("vec_id"), batch.column("label")]
            if last:
                parted, *safe = _safe(x, *books)
                gaps = (parted - np.stack([book[codes[:, p]] for p, book in enumerate(safe)], axis=1)).reshape(n, -1)
                out += [_lists(codes, pa.int32()), pa.array(np.minimum((gaps * gaps).sum(axis=1), MOST).astype(np.int64))]
            else:
                out += [batch.column("ints"), _lists(codes, pa.int32()), _lists(bounds.reshape(n, -1), pa.float32())]
            yield pa.RecordBatch.from_arrays(out, ["vec_id", "label", *(["codes", "error"] if last else ["ints", "codes", "bounds"])])

    return state.mapInArrow(run, schema)


def _means(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries as floor(sum / count) of their parts, unused ones as they are. Sums go in two halves of 32 bits, which
    two thousand million rows don't overflow."""
    width = books[0].shape[1]
    rows = state.select("ints", F.posexplode("codes").alias("part", "code"))
    cell = lambda i: F.element_at("ints", F.col("part") * width + i + 1)
    sums = [f(cell(i)).alias(f"{name}{i}") for i in range(width) for name, f in (("high", lambda c: F.sum(F.shiftright(c, 32))), ("low", lambda c: F.sum(c.bitwiseAND(F.lit(0xFFFFFFFF)))))]
    out = [[[int(x) for x in entry] for entry in book] for book in books]
    for r in rows.groupBy("part", "code").agg(F.count("*").alias("n"), *sums).collect():
        out[r["part"]][r["code"]] = [((r[f"high{i}"] << 32) + r[f"low{i}"]) // r["n"] for i in range(width)]
    return [np.array(book, np.int64) for book in out]


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> Codes:
    """Codes of rows(vec_id, label, ints): ``rounds`` of assignment and update from the vectors of the smallest ids, and
    a last assignment."""
    spark = rows.sparkSession
    rows = rows.filter((F.size("ints") > 0) & (F.size("ints") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("ints")]
    first = rows.orderBy(*order).select("ints").limit(1).collect()
    kinds = dict(rows.dtypes)
    if not first:
        return Codes(spark.createDataFrame([], f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"), [])
    rows = rows.filter(F.size("ints") == len(first[0]["ints"]))
    start = np.array([r["ints"] for r in rows.orderBy(*order).select("ints").limit(entries).collect()], np.int64)
    books = [np.ascontiguousarray(part) for part in np.split(start, parts, axis=1)]
    own = [entry_groups(book, groups) for book in books]
    state, before, path = rows, None, None
    for _ in range(rounds):
        made = new_path(spark, "codes")
        step = _assigned(state, books, before, own, groups, False)
        step.write.parquet(made)
        state = spark.read.schema(step.schema).parquet(made)
        if path:
            delete(spark, path)
        before, path = books, made
        books = _means(state, books)
    done = materialise(_assigned(state, books, before, own, groups, True), "coded")
    if path:
        delete(spark, path)
    return Codes(done, books)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the sum of errors of its label; labels are few beside rows, and their sums are broadcast after they are counted."""
    total: Column = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST)).cast("long")
    sums = materialise(coded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    sums = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = fit(whole_vectors(table(spark, sf_dir, "embeddings")))
    text = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code")
    return with_label_errors(codes.rows).select("vec_id", text, "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def _sql() -> str:
    """All rounds unrolled, by whole scans of all entries."""
    out = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
size AS (SELECT len(ints) // {PARTS} AS w FROM kept ORDER BY vec_id LIMIT 1),
parts AS MATERIALIZED (SELECT row, p, ints[p * w + 1 : (p + 1) * w] AS v, w FROM kept, size, range({PARTS}) AS r(p)),
book0 AS MATERIALIZED (SELECT p, j, v AS e FROM parts JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (row))"""
    for i in range(ROUNDS + 1):
        out += f""",
near{i} AS MATERIALIZED (SELECT row, p, min(struct_pack(d := list_sum(list_transform(range(1, w + 1), lambda i: (v[i] - e[i]) * (v[i] - e[i]))), j := j)) AS best, any_value(v) AS v FROM parts JOIN book{i} USING (p) GROUP BY row, p)"""
        if i < ROUNDS:
            out += f""",
mean{i} AS (SELECT p, j, list(m ORDER BY i) AS e FROM (SELECT p, best.j AS j, i, CAST(floor(CAST(sum(v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM near{i}, size, LATERAL (SELECT unnest(range(1, w + 1)) AS i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.j = m.j)"""
    return (
        out
        + f""",
coded AS (SELECT row, string_agg(printf('%02x', CAST(best.j AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest"""
    )


OP11_SQL = _sql()
