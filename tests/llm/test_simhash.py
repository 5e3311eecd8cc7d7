import re

import numpy as np
import pyarrow as pa
import xxhash
from tests.conftest import MEDIUM
from tests.llm.samples import SCHEMA, crowded, odd_documents

from netstrata.llm import bktree, simhash
from netstrata.llm.graph import components


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, linked):
    best = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if linked(a, b) and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    return best


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").limit(1000).collect()}
    prints = {d: plain_print(t) for d, t in docs.items()}
    values = np.array(list(prints.values()), np.uint64)
    near = {}
    for d, p in prints.items():
        near[d] = [e for e, hit in zip(prints, np.bitwise_count(values ^ np.uint64(p)) <= 3, strict=True) if hit]
    best, todo = {}, sorted(docs)
    for d in todo:
        if d not in best:
            stack = [d]
            while stack:
                x = stack.pop()
                if x not in best:
                    best[x] = d
                    stack += near[x]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, MEDIUM).collect()}
    assert got == {d: (f"{prints[d]:016x}", best[d]) for d in docs}


def test_hot_shards_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = {int(base[i % 6]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for i in range(300)}
    rows = [(i, int(np.uint64(p).view(np.int64))) for i, p in enumerate(sorted(prints))]
    value = {i: p & (2**64 - 1) for i, p in rows}
    table = spark.createDataFrame(rows, "node long, simhash long")
    best = plain_components(list(value), lambda a, b: (value[a] ^ value[b]).bit_count() <= 3)
    for hot in (4096, 8, 0):
        got = {r.node: r.component for r in components(simhash.link_fingerprints(table, 3, hot)).collect()}
        assert {i: got.get(i, i) for i in value} == best


def test_fingerprints_that_share_most_bits(spark):
    """Fingerprints with 40 equal bits: two of the four blocks are one shard each, however often they are cut the same way."""
    rng = np.random.default_rng(8)
    low = np.unique(rng.integers(0, 1 << 24, 50_000)).astype(np.uint64)
    value = (np.uint64(0xABCDE12345) << np.uint64(24)) | low
    table = spark.createDataFrame([(int(v), int(v)) for v in value.view(np.int64)], "node long, simhash long")
    shards = simhash._shards(table, 3, 4096).groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert shards <= 4096
    found = {r.node: r.component for r in components(simhash.link_fingerprints(table)).collect()}
    some = np.sort(rng.choice(len(value), 300, replace=False))
    for i in some:  # every link of some of them
        for j in np.flatnonzero(np.bitwise_count(value ^ value[i]) <= 3):
            a, b = (int(value.view(np.int64)[k]) for k in (i, j))
            assert found.get(a, a) == found.get(b, b)


def test_rows_without_ids_link_others(spark):
    rows = [(1, 0), (None, 7), (2, 63), (3, 1 << 40), (None, 15 << 50)]
    found = sorted((r.doc_id or 0, r.simhash, r.component_id) for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, simhash long")).collect())
    assert found == sorted([(1, 0, 1), (0, 7, 1), (2, 63, 1), (3, 1 << 40, 1), (0, 15 << 50, None)], key=lambda r: r[:2])


def test_forest_finds_what_brute_force_finds():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**64, (400, 2), dtype=np.uint64) & rng.integers(0, 2**64, (1, 2), dtype=np.uint64) & np.uint64(0x0F0F0F0F0F0F0F0F)
    prints = np.unique(prints, axis=0)
    shard = np.sort(rng.integers(0, 4, len(prints)))
    forest = bktree.Forest(shard, prints)
    hits = {(int(a), int(b)) for x in forest.search(np.arange(len(prints)), 9) for a, b in zip(x[0], x[1], strict=True)}
    want = {(a, b) for a in range(len(prints)) for b in range(len(prints)) if a != b and shard[a] == shard[b] and bktree.hamming(prints[a : a + 1], prints[b : b + 1])[0] <= 9}
    assert hits == want and want


def test_unions_in_place_lose_no_link():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        labels, best = np.arange(12), {i: {i} for i in range(12)}
        for _ in range(4):
            a, b = rng.integers(0, 12, (2, 4))
            bktree.smallest_linked(labels, a, b)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                whole = best[x] | best[y]
                best.update(dict.fromkeys(whole, whole))
        assert labels.tolist() == [min(best[i]) for i in range(12)]


def test_crowds_with_overlapping_leaders():
    for seed in range(25):
        rng = np.random.default_rng(seed)
        centres = rng.integers(0, 2**62, (4, 2), dtype=np.uint64)
        flips = lambda: [np.uint64(sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 9), replace=False))) for _ in range(2)]
        prints = np.unique(np.array([centres[i % 4] ^ np.array(flips(), np.uint64) for i in range(200)]), axis=0)
        shard, accept = np.zeros(len(prints), np.int64), lambda a, b, d: (a + b) % 5 != 0
        for radius in (8, 16, 24):
            plain = bktree.components(shard, prints, radius, accept, visits=500)
            assert np.array_equal(plain, bktree.components(shard, prints, radius, accept, crowded=16))


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, i) for i in range(100, 140)] + [(5, 5), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys([*range(100, 140), 200], 100), 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_odd_rows(spark):
    docs = crowded(odd_documents(spark), "simhash", "node", "component", "shard")
    rows = simhash.similar_groups(simhash.fingerprints(docs)).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r.component_id for r in rows if r.doc_id != 7}
    assert by[14] == by[21] == by[28] == 14
    assert {r.component_id for r in rows if r.doc_id == 7} == {0, 7}
    assert simhash.similar_groups(simhash.fingerprints(spark.createDataFrame([], SCHEMA))).collect() == []


def test_sets_are_read_from_folders_that_are_not_mounted(spark, tmp_path):
    from netstrata.llm.common import create, new_path, read_at

    sets = [np.arange(40, dtype=np.uint64), np.arange(2, 40, dtype=np.uint64), np.zeros(0, np.uint64), np.arange(100, 130, dtype=np.uint64)]
    # a file system in memory stands for one that is reached by its address only
    for folder in ("mock:///shared/sets", f"file:{tmp_path}/sets", f"{tmp_path}/more", new_path(spark, "sets")):
        places = []
        with create(f"{folder}/one") as out:
            for x in sets:
                places.append(out.tell())
                out.write(x.tobytes())
        rows = pa.table({"file": [f"{folder}/one"] * 4, "place": places, "n_shingles": pa.array(map(len, sets), pa.int64())})
        held = simhash.ShingleSets(rows)
        assert all(np.array_equal(held.hashes(i), x) for i, x in enumerate(sets))
        assert held.similar(np.array([0, 0, 0]), np.array([1, 2, 3])).tolist() == [True, False, False]
        assert read_at(f"{folder}/one", places[3] + 8, 8) == sets[3][1:2].tobytes()


def test_broadcasts_are_counted(spark):
    from netstrata.llm.common import few

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower() or "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(few(spark.range(5), 5)) and not hinted(few(spark.range(6), 5)) and hinted(few(spark.range(0), 5))
