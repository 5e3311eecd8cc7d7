import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import MEDIUM, SMALL
from tests.llm.samples import SCHEMA, odd_documents

import corpus_pipeline as pipeline
from netstrata.llm import bktree, langid, lines, simhash
from netstrata.llm.common import materialise
from tests.llm.test_suffix import plainly


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_duplicates_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    docs |= {r.doc_id + 10**6: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("doc_id % 2 = 0").collect()}
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs.items()], SCHEMA)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(table).collect()}
    sets, ids = {i: shingles(t) for i, t in docs.items()}, sorted(docs)
    close = 0
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            j = similarity(sets[a], sets[b])
            if j >= 0.8:
                assert group[a] == group[b]
                close += 1
    assert close > 20
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(i)
    for own in members.values():  # everyone in a group is near to another one in it
        for i in own if len(own) > 1 else []:
            assert max(similarity(sets[i], sets[o]) for o in own if o != i) > 0.6


def test_crowds_and_hot_shards(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    base = [[word() for _ in range(300)] for _ in range(3)]
    rows = []
    for i in range(240):
        text = list(base[i % 3])
        for at in rng.integers(0, 300, 3):
            text[at] = word()
        rows.append((i, " ".join(text), "en", "s", 0))
    common = " ".join(base[0][:20])
    rows += [(1000 + i, common + " " + " ".join(word() for _ in range(100)), "en", "s", 0) for i in range(100)]
    table = spark.createDataFrame(rows, SCHEMA)
    for hot in (4096, 20):
        group = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(table, hot).collect()}
        assert all(group[i] == i % 3 for i in range(240))
        assert all(group[1000 + i] == 1000 + i for i in range(100))


def test_clustering_loses_no_link():
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 2**63, (6, 2), dtype=np.uint64)
    prints = np.unique(np.array([[np.uint64(int(w) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False))) for w in centres[i % 6]] for i in range(500)]), axis=0)
    shard, radius = np.zeros(len(prints), np.int64), 14
    accept = lambda a, b, d: (a + b) % 7 != 0
    plain = bktree.components(shard, prints, radius, accept)
    crowd = bktree.components(shard, prints, radius, accept, crowded=16)
    assert np.array_equal(plain, crowd) and len(np.unique(plain)) < len(prints)


def test_stages_on_whole_tables(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = materialise(stage(spark, docs, MEDIUM), name)
        assert out.columns == pipeline.COLUMNS
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in after.values())
        if name == "language_id":
            assert len(after) >= 0.999 * len(before) and all(after[i].text == before[i].text for i in after)
        if name == "line_dedup":
            assert set(after) == set(before) and any(after[i].text != before[i].text for i in after)
        if name == "near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}
            kept = sorted(after)
            assert all(similarity(sets[a], sets[b]) < 0.8 for x, a in enumerate(kept) for b in kept[x + 1 :])
            for gone in set(before) - set(after):
                assert max(similarity(sets[gone], sets[i]) for i in before if i != gone) > 0.6
        if name == "suffix_dedup":
            want = plainly(sorted((i, r.text) for i, r in before.items()))
            assert set(after) == set(before)
            assert all((after[i].text == before[i].text) == (want[i][1] == 0) for i in after)
            assert all(want[i][0] - want[i][1] - 4 * want[i][2] * 2 <= len(after[i].text.encode()) <= want[i][0] - want[i][1] for i in after)
        docs = out
    pieces = pipeline.STAGES[-1][1](spark, docs, MEDIUM)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    rows = pipeline.run(spark, SMALL)
    fill = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top")).collect()
    assert fill and all(r.n == r.top <= 4096 for r in fill)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    docs = odd_documents(spark).withColumns({"_id": F.lit(1), "shard": F.lit(2), "_lang": F.lit("q"), "component_id": F.lit(0)})
    docs = docs.filter("false") if empty else docs
    for name, stage in pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), name)
    assert (docs.count() == 0) == empty


def test_near_duplicates_keep_one_row(spark):
    docs = odd_documents(spark)
    rows = simhash.near_duplicates(docs).collect()
    ids = [r.doc_id for r in rows]
    assert ids.count(0) == 1 and None in ids and ids.count(14) == 1 and 21 not in ids and 28 not in ids
    assert [r.text for r in rows if r.doc_id == 7] == ["another text with the id 7"]


def test_model_free_stages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert langid.calibrate(none, None) == {}
    assert lines.widespread_hits(none).collect() == []


def test_near_duplicates_link_at_the_similarity_only(spark):
    texts = {}

    def pair(at, shared, own):  # two texts of shared + own words each: shared - 4 shingles in common
        words = [f"w{at}x{i}" for i in range(shared)]
        texts[at], texts[at + 1] = (" ".join(words + [f"{side}{at}x{i}" for i in range(own)]) for side in "ab")

    for n in range(40):
        pair(100 + 2 * n, 404, 50)  # 400 of 500 shingles: 0.8
        pair(300 + 2 * n, 404, 54)  # 400 of 508: 0.787
        pair(500 + 2 * n, 404, 60)  # 400 of 520: 0.769
        texts[700 + 2 * n] = " ".join(f"s{n}x{i}" for i in range(8))
        texts[701 + 2 * n] = texts[700 + 2 * n] + " more"  # 4 of 5 shingles: 0.8
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(table).collect()}
    for first in range(100, 780, 2):
        if first in texts:
            near = similarity(shingles(texts[first]), shingles(texts[first + 1])) >= 0.8
            assert near == (first < 300 or first >= 700)
            assert group[first + 1] == (first if near else first + 1)


def test_crowded_shards_are_split_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(10)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
    rows, base = [], [word() for _ in range(300)]
    for i in range(200):  # near copies of one text
        text = list(base)
        for at in rng.integers(0, 300, 3):
            text[at] = word()
        rows.append((i, " ".join(text), "en", "s", 0))
    long = [word() for _ in range(2400)]
    rows += [(1000 + i, " ".join(long[20 * i : 20 * i + 400]), "en", "s", 0) for i in range(100)]  # a chain
    table = spark.createDataFrame(rows, SCHEMA)
    largest, local_edges = [], simhash._local_edges

    def spy(shards, *rest):
        shards = materialise(shards, "spied")
        largest.append(max(r["count"] for r in shards.groupBy("shard").count().collect()))
        return local_edges(shards, *rest)

    monkeypatch.setattr(simhash, "_local_edges", spy)
    group = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(table, 12).collect()}
    assert all(group[i] == (0 if i < 1000 else 1000) for i in group) and len(group) == 300
    assert max(largest) <= 36
