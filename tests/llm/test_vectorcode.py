import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.conftest import MEDIUM
from tests.llm.samples import crowded

from netstrata.llm import vectorcode as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)} and the codebooks, by whole scans with Python's integers."""
    kept = [(i, v, [math.floor(4096 * x) for x in e]) for i, (v, e, _) in enumerate(rows) if e and all(x is not None and math.isfinite(x) for x in e) and len(e) % parts == 0]
    order = sorted(kept, key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    if not order:
        return {}, []
    kept = [r for r in kept if len(r[2]) == len(order[0][2])]
    order = [r for r in order if len(r[2]) == len(order[0][2])]
    w = len(order[0][2]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in order[:entries]] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min((square(v, e), j) for j, e in enumerate(book))[1]
    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, _, v in kept:
                mine[nearest(cut(v, p), books[p])].append(cut(v, p))
            books[p] = [[sum(c) // len(mine[j]) for c in zip(*mine[j], strict=True)] if j in mine else e for j, e in enumerate(books[p])]
    codes = {i: [nearest(cut(v, p), books[p]) for p in range(parts)] for i, _, v in kept}
    return {i: (c, sum(square(cut(v, p), books[p][c[p]]) for p in range(parts))) for i, _, v in kept for c in [codes[i]]}, books


def check(spark, rows):
    codes, books = plain(rows)
    found = vc.fit(vc.whole_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert [b.tolist() for b in found.codebooks] == books
    want = sorted((repr(rows[i][0]), rows[i][2] or -1, c, min(e, vc.MOST)) for i, (c, e) in codes.items())
    assert sorted((repr(r.vec_id), r.label or -1, list(r.codes), r.error) for r in found.rows.collect()) == want


def test_query_against_whole_scans(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    codes, books = plain(rows)
    label = defaultdict(int)
    for i, (_, error) in codes.items():
        label[rows[i][2]] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((rows[i][0], "".join(f"{x:02x}" for x in c), e, label[rows[i][2]], digest) for i, (c, e) in codes.items())
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, vc.op11_vector_codes(spark, MEDIUM).select(*names).collect())) == want
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{MEDIUM}/embeddings.parquet'")
    assert sorted(con.execute(f"select {', '.join(names)} from ({vc.OP11_SQL})").fetchall()) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 16) / 4096], i % 3 if i % 4 else None) for i in range(60)]  # ties everywhere
    rows += [rows[5], rows[5], (5, [0.5] * 16, 9), (None, [0.25] * 16, None), (3, None, 1), (4, [None] * 16, 1), (6, [float("nan")] + [0.0] * 15, 1), (7, [float("inf")] * 16, 1), (8, [], 1), (9, [1.0] * 8, 1), (10, [1.0] * 15, 1)]
    check(spark, rows)
    check(spark, rows[:7])  # fewer rows than entries
    found = vc.with_label_errors(vc.fit(vc.whole_vectors(crowded(spark.createDataFrame(rows, SCHEMA), "codes", "bounds", "error", "ints", "part"))).rows).collect()
    assert all(r.label_error == sum(o.error for o in found if o.label == r.label) for r in found)


def test_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1e6 if i % 2 else 1e14, 8)], 0) for i in range(40)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)]])
def test_nothing_to_code(spark, rows):
    found = vc.fit(vc.whole_vectors(spark.createDataFrame(rows, SCHEMA)))
    assert vc.with_label_errors(found.rows).collect() == [] and found.codebooks == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.sampled_from([1, 4, 40, 4000]))
def test_bounds_never_hide_an_entry(seed, m, spread):
    """Rounds with bounds give the same as whole scans, ties included, and scan less."""
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread + 1, (200, 4)), rng.integers(-spread, spread + 1, (m, 4))
    own = vc.entry_groups(book, 4)
    codes, upper, lower = vc.first_codes(x, book, own, 4)
    for _ in range(5):
        after = book + rng.integers(-1 - spread // 8, 2 + spread // 8, book.shape)
        codes, upper, lower, made = vc.next_codes(x, after, book, own, codes, upper, lower)
        whole = vc.squares(x, after)
        assert (codes == whole.argmin(axis=1)).all() and made <= 200 * (m + 1)
        assert (upper.astype(float) ** 2 >= whole[np.arange(200), codes] * (1 - 1e-12)).all()
        for g in range(4):
            rest = np.where((own == g)[None, :] & (np.arange(m)[None, :] != codes[:, None]), whole, np.inf).min(axis=1)
            assert (np.maximum(lower[:, g].astype(float), 0) ** 2 <= rest * (1 + 1e-12)).all()
        book = after


def test_settled_rows_are_not_scanned():
    rng = np.random.default_rng(0)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    x = centres[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 8))
    own = vc.entry_groups(centres, 4)
    state = vc.first_codes(x, centres, own, 4)
    assert vc.next_codes(x, centres + 5, centres, own, *state)[3] == 0
