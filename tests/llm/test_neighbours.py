import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.conftest import MEDIUM
from tests.llm.samples import crowded

from netstrata.llm import neighbours as nb
from netstrata.llm.vptree import NONE, Router, Tree, distances

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, ids, k=10):
    """{query: [(score, vec_id)]} by comparing with all rows; a null id is last among ties."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q in ids:
            found = [(float(np.sqrt(((v - x) ** 2).sum())), NONE if i is None else i) for i, x in good if i != q and len(x) == len(v)]
            out[q] = sorted(found)[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, NONE if r.vec_id is None else r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def agree(got, want):
    assert got.keys() == {q for q, rows in want.items() if rows}
    for q in got:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=1e-12)


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{MEDIUM}/embeddings.parquet").collect()]
    want, got = plain(rows, range(0, 10_000, 100)), found(nb.op13_nearest_neighbours(spark, MEDIUM))
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert sum(len(set(got[q]) & {(s, i) for s, i in want[q]}) for q in got) >= 0.9 * 10 * len(want)


def test_factor_one_is_exact(spark, monkeypatch):
    """Several shards, one of copies, and queries that look in all of them."""
    monkeypatch.setattr(nb, "LEAST_ROWS", 32)
    monkeypatch.setattr(nb, "ROWS_A_ROOT", 1)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6) + 6 * (i % 3)]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(None, rows[7][1]), (None, rows[0][1])]
    rows += [(2000 + i, [float(i + 1)] * 4) for i in range(5)]  # another length
    rows += [(3000, None), (3050, [0.0] * 6), (3100, [float("nan")] * 6), (3150, [None] * 6), (3200, [])]
    docs = crowded(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), "shard", "part", "row", "reach", "query")
    agree(found(nb.nearest(docs, F.col("vec_id") % 50 == 0, stretch=1.0)), plain(rows, range(0, 10_000, 50)))


def test_few_rows_and_repeated_ones(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]
    got = found(nb.nearest(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), F.col("vec_id") == 0))
    assert [i for _, i in got[0]] == [1, 1, 2]
    one = spark.createDataFrame([(0, [1.0, 0.0], 0)], SCHEMA)
    assert nb.nearest(one, F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("rows", [[], [(0, None, 1)]])
def test_empty(spark, rows):
    assert nb.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.sampled_from([2, 5]), st.sampled_from([2, 1000]))
def test_tree_is_exact(seed, n, d, values):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(0, values, (n, d)).astype(float), rng.integers(0, values, (7, d)).astype(float)
    score, ids = Tree(x, np.arange(n), leaf=8).nearest(q, np.full(7, -1), np.full(7, np.inf), 5, 1.0)
    for i in range(7):
        far = distances(x, q[i])
        best = np.lexsort((np.arange(n), far))[:5]
        assert ids[i][: len(best)].tolist() == best.tolist() and np.allclose(score[i][: len(best)], far[best])


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20))
def test_router_bounds_hold(seed, shards):
    rng = np.random.default_rng(seed)
    x, q = rng.normal(0, 1, (200, 4)), rng.normal(0, 1, (20, 4))
    router = Router(x[:60], shards)
    home, least = router.shard(x), router.least(q)
    assert router.shards <= max(1, shards) and ((home >= 0) & (home < router.shards)).all()
    for i in range(20):
        far = distances(x, q[i])
        assert (least[i][home] <= far + 1e-9).all()


def test_stretch_searches_less():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (4000, 16))
    tree, q = Tree(x, np.arange(4000)), rng.normal(0, 1, (50, 16))
    looked = []
    for stretch in (1.0, 3.0):
        n = [0]
        scan = Tree._scan
        tree._scan = lambda rows, active, n=n, scan=scan: (n.__setitem__(0, n[0] + len(rows) * len(active)), scan(tree, rows, active))
        tree.nearest(q, np.full(50, -1), np.full(50, np.inf), 10, stretch)
        looked.append(n[0])
    assert looked[1] < looked[0]
