"""Operators against hand-made cases, plain versions and properties."""

import itertools
import math
import os
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.plain import modularity, naive_linkage, plain_nndsvd, plain_replicate, sampled

from netstrata.functions import scratch, tails
from netstrata.jobs import stratify as job
from netstrata.jobs.stratify import stratify
from netstrata.operators import clean, clusters, consensus, diffusion, enrichment, factorize, hierarchy, hubs, mapping, matrixrows, network, normalize, packed, points, profiles, running, stats, svd, sweep
from netstrata.sources import io

PAIRS = [(1, 2), (1, 4), (2, 6), (3, 6), (4, 6), (5, 5), (2, 1)]


def dense(rows, n, m=None):
    out = np.zeros((n, m or n))
    for r in rows:
        out[r[0], r[1]] = r[2]
    return out


def cells(spark, matrix, names):
    i, j = np.nonzero(matrix)
    return spark.createDataFrame([(int(a), int(b), float(matrix[a, b])) for a, b in zip(i, j, strict=True)], f"{names[0]} long, {names[1]} long, {names[2]} double")


# Networks and cleaning


def test_adjacency_of_the_tiny_case(spark):
    pairs = spark.createDataFrame(PAIRS, "a long, b long")
    binary = {(r.src, r.dst): r.weight for r in network.binary_adjacency(pairs, "a", "b").collect()}
    assert set(binary) == {(x, y) for a, b in PAIRS for x, y in ((a, b), (b, a))} and set(binary.values()) == {1.0}
    counted = {(r.src, r.dst): r.weight for r in network.count_adjacency(pairs, "a", "b").collect()}
    assert counted[1, 2] == counted[2, 1] == 2 and counted[3, 6] == 1 and (5, 5) not in counted
    assert {r.gene: r.degree for r in network.gene_degree(network.binary_adjacency(pairs, "a", "b")).collect()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 1, 6: 3}


def test_top_fraction(spark):
    rng = np.random.default_rng(1)
    for scores in (rng.integers(0, 5, 200).tolist(), rng.random(50).tolist(), [3.0] * 20, []):
        rows = [(i, float(s)) for i, s in enumerate(scores)]
        got = clean.top_fraction(spark.createDataFrame(rows, "id long, score double"), "score", 0.25, ["id"]).collect()
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[: round(len(rows) * 0.25)]
        assert sorted(map(tuple, got)) == sorted(want)


def test_validation(spark):
    edges = network.binary_adjacency(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")
    assert clean.validate_network(edges).count() == 4
    for bad in ([(1, 2, 1.0)], [(1, 1, 1.0)], [(1, 2, 1.0), (2, 1, 2.0)], [(1, 2, 1.0), (1, 2, 1.0)]):
        with pytest.raises(ValueError):
            clean.validate_network(spark.createDataFrame(bad, "src long, dst long, weight double"))
    for bad in ([(1, 2, -1.0)], [(1, 2, 1.0), (1, 2, 1.0)], [(1, 2, None)], [(1, 2, float("nan"))]):
        with pytest.raises(ValueError):
            clean.validate_profile(spark.createDataFrame(bad, "individual long, gene long, value double"))


def test_small_cleaning(spark):
    rows = spark.createDataFrame([("a.s1", 1.0), ("b.p2", None), ("x", float("nan")), (None, 2.0)], "id string, v double")
    assert [r.role for r in clean.role_from_id(rows, "id").collect()] == ["sibling", "proband", None, None]
    named = spark.createDataFrame([("ABC", 1.0), ("D~withdrawn", 2.0), ("E", None), ("F", float("nan")), ("G", float("inf"))], "s string, e double")
    assert [tuple(r) for r in clean.clean_symbols(named, "s", "e").collect()] == [("ABC", 1)]
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k long, v string")
    assert sorted(r.v for r in clean.drop_ambiguous(twice, "k").collect()) == ["c", "d"]
    prefixed = spark.createDataFrame([("9606.E1",), ("96060E2",)], "p string")
    assert [r.q for r in clean.strip_prefix(prefixed, {"p": "q"}, "9606.").collect()] == ["E1", "96060E2"]


def test_symmetrize_properties(spark):
    rng = np.random.default_rng(2)
    m = rng.random((30, 30)) * (rng.random((30, 30)) < 0.5)
    table = cells(spark, m, ("src", "dst", "value"))
    low, high = (dense([tuple(r) for r in network.symmetrize(table, how).collect()], 30) for how in ("min", "max"))
    assert np.allclose(low, np.minimum(m, m.T)) and np.allclose(high, np.maximum(m, m.T)) and (low <= high).all()


def test_align_genes_drops_isolated(spark):
    edges = network.binary_adjacency(spark.createDataFrame([(1, 2)], "a long, b long"), "a", "b")
    mut = spark.createDataFrame([(10, 1, 1.0), (10, 9, 1.0)], "individual long, gene long, value double")
    genes, kept, profile = network.align_genes(edges, mut)
    assert {(r.gene, r.gene_class, r.degree) for r in genes.collect()} == {(1, "common", 1.0), (2, "network_only", 1.0), (9, "mutation_only", 0.0)}
    assert kept.count() == 2 and [r.gene for r in profile.collect()] == [1]
    assert network.final_profile(mut, genes, True).count() == 2


# Files


def test_files(spark, tmp_path):
    (tmp_path / "links").write_text("protein1 protein2 combined_score\n9606.A 9606.B 900\n\n9606.B  9606.C 10\n")
    assert [tuple(r) for r in io.read_interactions(spark, str(tmp_path / "links"), "links").collect()] == [("9606.A", "9606.B", 900), ("9606.B", "9606.C", 10)]
    (tmp_path / "carriers").write_text("entrez_id;who;oe\n1;['a', \"b\"];0.5\n2;[];1\n3;;2\n4;['a'];3\n")
    assert sorted(map(tuple, io.read_carriers(spark, str(tmp_path / "carriers"), "who", "oe").collect())) == [(1, "a", 0.5), (1, "b", 0.5), (4, "a", 3.0)]
    (tmp_path / "wide").write_text("gene\tx.1\ty\nG1\t0\t2\nG2\t1.5\t0\n")
    assert sorted(map(tuple, io.read_wide_profile(spark, str(tmp_path / "wide")).collect())) == [("G1", "y", 2.0), ("G2", "x.1", 1.5)]
    (tmp_path / "ids").write_text("a\n\n b \n")
    assert [r.individual for r in io.read_id_list(spark, str(tmp_path / "ids")).collect()] == ["a", "b"]
    (tmp_path / "genes").write_text("entrez_id\n5\n\n7\n")
    assert sorted(r.gene for r in io.read_gene_set(spark, str(tmp_path / "genes")).collect()) == [5, 7]
    (tmp_path / "named").write_text("GeneName_A\tUniprotID_A\tUniprotName_A\tGeneName_B\tUniprotID_B\tUniprotName_B\nA\tP1\tA_HUMAN\t\tP2\tB_MOUSE\n")
    found = io.read_interactions(spark, str(tmp_path / "named"), "named")
    assert found.first().GeneName_B is None and clean.filter_species(found, ["UniprotName_A", "UniprotName_B"], "HUMAN").count() == 0


# Diffusion and normalisation


def random_case(spark, seed=3, n=25, m=20):
    rng = np.random.default_rng(seed)
    a = rng.random((m, m)) < 0.2
    a = np.triu(a, 1)
    a = (a | a.T).astype(float)
    x = (rng.random((n, m)) < 0.2).astype(float)
    return x, a, cells(spark, x, ("individual", "gene", "value")), cells(spark, a, ("src", "dst", "weight"))


def column_normalised(a):
    used = a.any(axis=0)
    b = a.copy()
    b[used, used] = 1
    return b / np.where(b.sum(0) == 0, 1, b.sum(0)), used


def test_propagation(spark):
    x, a, profile, edges = random_case(spark)
    net, used = column_normalised(a)
    table = diffusion.normalize_network(edges)
    assert np.allclose(dense([tuple(r) for r in table.collect()], 20), net)
    assert sorted(map(tuple, diffusion.propagate(profile, table, 0.0).collect())) == sorted(map(tuple, profile.collect()))
    one = dense([tuple(r) for r in diffusion.propagate(profile, table, 0.7).collect()], 25, 20)
    assert np.allclose(one, 0.7 * x @ net + 0.3 * x)
    now = x
    while True:
        new = 0.5 * now @ net + 0.5 * x
        done, now = np.linalg.norm(new - now) <= 0.05, new
        if done:
            break
    assert np.allclose(dense([tuple(r) for r in diffusion.propagate(profile, table, 0.5, 0.05).collect()], 25, 20), now)


def test_influence_blocks_are_the_relational_form(spark, monkeypatch):
    _, a, _, edges = random_case(spark)
    net, _ = column_normalised(a)
    one = (0.6 * np.eye(20) @ net + 0.4 * np.eye(20)) * a
    assert np.allclose(dense([tuple(r) for r in diffusion.network_influence(edges, 0.6).collect()], 20), one)
    two = (0.6 * (0.6 * np.eye(20) @ net + 0.4 * np.eye(20)) @ net + 0.4 * np.eye(20)) * a
    for numbers, most in ((1 << 23, 10**6), (300, 10**6), (300, 3)):  # one block, many blocks, too large for blocks
        monkeypatch.setattr(diffusion, "BLOCK_NUMBERS", numbers)
        for steps, want in ((1, one), (2, two)):
            assert np.allclose(dense([tuple(r) for r in diffusion.influence_blocks(edges, 0.6, steps, most).collect()], 20), want)


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_quantile_normalisation(spark, stat):
    rng = np.random.default_rng(4)
    x = np.round(rng.random((12, 9)) * 4) * (rng.random((12, 9)) < 0.7)
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    levels = getattr(np, stat)(ordered, axis=1)
    want = np.array([[levels[(x[:, g] < x[i, g]).sum()] for g in range(9)] for i in range(12)])
    found, zero = normalize.quantile_normalize(cells(spark, x, ("individual", "gene", "value")), 12, 9, stat)
    for r in found.collect():
        assert abs(r.value - want[r.individual, r.gene]) < 1e-9
    assert found.count() == (x > 0).sum() and abs(zero.first().zero - levels[0]) < 1e-9


def test_communities(spark):
    blocks = [range(0, 6), range(6, 12), range(12, 18)]
    edges = [(i, j) for b in blocks for i, j in itertools.combinations(b, 2)] + [(0, 6), (7, 12)]
    found = {r.gene: r.community for r in diffusion.communities(network.binary_adjacency(spark.createDataFrame(edges, "a long, b long"), "a", "b")).collect()}
    assert len(found) == 18
    for b in blocks:
        assert len({found[i] for i in b}) == 1
    assert len(set(found.values())) == 3


def test_communities_of_packed_networks(spark, monkeypatch):
    """Labels that all tasks hold move as those of tables do, over several levels and slices."""
    rng = np.random.default_rng(19)
    pairs = [(f"g{a}", f"g{b}") for a, b in itertools.combinations(range(60), 2) if rng.random() < (0.6 if a // 6 == b // 6 else 0.08 if a // 20 == b // 20 else 0.02)]
    table = network.binary_adjacency(spark.createDataFrame(pairs, "a string, b string"), "a", "b")
    with monkeypatch.context() as m:
        m.setattr(packed, "communities", lambda *_: None)
        want = sorted(map(tuple, diffusion.communities(table).collect()))
    monkeypatch.setattr(packed, "EDGES", 40)
    monkeypatch.setattr(diffusion, "_moved", lambda *_: 1 / 0)
    assert sorted(map(tuple, diffusion.communities(table).collect())) == want


def test_propagation_in_blocks(spark, monkeypatch):
    """Blocks of individuals over a packed network end at the step at which tables end; genes without edges keep their share."""
    rng = np.random.default_rng(20)
    table = network.binary_adjacency(spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 30, (70, 2)) if a != b], "a long, b long"), "a", "b")
    profile = spark.createDataFrame([(f"i{i % 7}", int(g), float(i % 3 + 1)) for i, g in enumerate(rng.permutation(35))], "individual string, gene long, value double")
    net = diffusion.normalize_network(table)
    with monkeypatch.context() as m:
        m.setattr(packed, "MOST_CELLS", 0)
        want = {(r.individual, r.gene): r.value for r in diffusion.propagate(profile, net, 0.6, 0.05).collect()}
    monkeypatch.setattr(packed, "BLOCK", 100)
    monkeypatch.setattr(packed, "EDGES", 20)
    monkeypatch.setattr(diffusion, "one_step", lambda *_: 1 / 0)
    got = {(r.individual, r.gene): r.value for r in diffusion.propagate(profile, net, 0.6, 0.05).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_propagation_in_parts(spark, monkeypatch):
    """A step in parts of the individuals gives the same, and no part meets as many rows as the whole."""
    rng = np.random.default_rng(21)
    net = diffusion.normalize_network(network.binary_adjacency(spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2)) if a != b], "a long, b long"), "a", "b"))
    profile = spark.createDataFrame([(i, int(g), 1.0) for i in range(12) for g in rng.choice(20, 4, False)], "individual long, gene long, value double")
    want = sorted(map(tuple, diffusion.propagate(profile, net, 0.6).collect()))
    sizes, step = [], diffusion.one_step
    monkeypatch.setattr(diffusion, "PART_ROWS", 60)
    monkeypatch.setattr(diffusion, "PART_NETWORKS", 0)
    monkeypatch.setattr(diffusion, "one_step", lambda now, *more: sizes.append(now.count()) or step(now, *more))
    got = sorted(map(tuple, diffusion.propagate(profile, net, 0.6).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    assert len(sizes) > 2 and sum(sizes) == 48 and max(sizes) < 48


def test_influence_in_parts(spark, monkeypatch):
    """Two steps from parts of the seeds; cells that are no edges are deleted after each part."""
    rng = np.random.default_rng(23)
    edges = scratch.materialise(network.binary_adjacency(spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 20, (40, 2)) if a != b], "a long, b long"), "a", "b"), "edges")
    want = sorted(map(tuple, diffusion.influence_blocks(edges, 0.6, 2).collect()))
    monkeypatch.setattr(diffusion, "PART_ROWS", 150)
    monkeypatch.setattr(diffusion, "PART_NETWORKS", 0)
    paths, new = [], scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda spark, name: paths.append(new(spark, name)) or paths[-1])
    got = sorted(map(tuple, diffusion.influence_blocks(edges, 0.6, 2, most_edges=0).collect()))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
    steps = [path for path in paths if "/diffusion-" in path]
    assert len(steps) > 4 and not any(os.path.exists(path.removeprefix("file:")) for path in steps)


def test_quantiles_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(22)
    profile = spark.createDataFrame([(i, g, float(rng.integers(1, 4))) for i in range(9) for g in range(11) if rng.random() < 0.6], "individual long, gene long, value double")
    want = [[sorted(map(tuple, df.collect())) for df in normalize.quantile_normalize(profile, 9, 11, stat)] for stat in ("mean", "median")]
    monkeypatch.setattr(normalize, "PART_CELLS", 10)
    kept, write = [], normalize.materialise
    monkeypatch.setattr(normalize, "materialise", lambda df, name: kept.append(name) or write(df, name))
    assert [[sorted(map(tuple, df.collect())) for df in normalize.quantile_normalize(profile, 9, 11, stat)] for stat in ("mean", "median")] == want
    assert len(kept) > 4


# Factorisation


def factor_arrays(w, h, n, m, k):
    a, b = np.zeros((n, k)), np.zeros((k, m))
    for r in w.collect():
        a[r.id] = r.weights
    for r in h.collect():
        b[:, r.id] = r.weights
    return a, b


def test_gnmf_is_the_update_rule_and_falls(spark):
    rng = np.random.default_rng(5)
    x = rng.random((10, 8)) + 0.1
    a = np.triu(rng.random((8, 8)) < 0.4, 1)
    a = (a | a.T).astype(float)
    profile, edges = cells(spark, x, ("individual", "gene", "value")), cells(spark, a, ("src", "dst", "weight"))
    w0, h0 = rng.random((10, 2)) + 0.1, rng.random((2, 8)) + 0.1
    start = lambda f: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(f)], "id long, weights array<double>")
    e, d, lambd = factorize.EPS, a.sum(0), 0.5
    h1 = h0 * (lambd * h0 @ a + w0.T @ ((x + e) / (w0 @ h0 + e)) + e) / (lambd * h0 * d + w0.sum(0)[:, None] + e)
    w1 = w0 * (((x + e) / (w0 @ h1 + e)) @ h1.T + e) / (h1.sum(1)[None, :] + e)
    w, h = factorize.gnmf(profile, edges, start(w0), start(h0.T), 2, lambd, 1)
    got = factor_arrays(w, h, 10, 8, 2)
    assert np.allclose(got[0], w1) and np.allclose(got[1], h1)
    error = factorize.reconstruction_error(profile, w, h, 2).first().error
    assert abs(error - np.linalg.norm(x - w1 @ h1)) < 1e-9
    divergence = lambda f, g: (x * np.log(x / (f @ g)) - x + f @ g).sum()
    last = math.inf
    w, h = start(w0), start(h0.T)
    for _ in range(4):
        w, h = factorize.gnmf(profile, None, w, h, 2, 0.0, 1)
        new = divergence(*factor_arrays(w, h, 10, 8, 2))
        assert new <= last + 1e-9
        last = new


def test_nndsvd_and_nmf(spark, one_round):
    rng = np.random.default_rng(6)
    x = (rng.random((15, 2)) @ rng.random((2, 10))) + 0.01
    profile = cells(spark, x, ("individual", "gene", "value"))
    w, h = (factor_arrays(*factorize.nndsvd_init(profile, 2), 15, 10, 2))
    assert (w >= 0).all() and (h >= 0).all()
    u, s, _ = np.linalg.svd(x)
    assert np.allclose(w[:, 0], np.abs(u[:, 0]) * np.sqrt(s[0]))
    w, h = factorize.nmf(profile, 2, max_iter=12)
    a, b = factor_arrays(w, h, 15, 10, 2)
    assert np.linalg.norm(x - a @ b) < 0.02 * np.linalg.norm(x) and (a >= 0).all() and (b >= 0).all()


def test_hoyer(spark):
    table = spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 1.0), (2, 1.0), (2, 1.0)], "k long, value double")
    assert {r.k: round(r.sparseness, 9) for r in profiles.hoyer_sparseness(table, "k", 4).collect()} == {1: 1.0, 2: 0.0}


# Consensus and trees


def test_consensus_blocks_are_brute_force(spark):
    rng = np.random.default_rng(7)
    labels = {(r, i): int(rng.integers(0, 3)) for r in range(6) for i in range(17) if rng.random() < 0.7}
    table = spark.createDataFrame([(r, i, c) for (r, i), c in labels.items()], "replicate int, id long, cluster int")
    found = {(r.id_a, r.id_b): r for r in consensus.pairwise(consensus.label_vectors(table, 6), "id", "labels", 17, consensus._agreement, "n_joint long, n_same long", block=4).collect()}
    assert len(found) == 17 * 16 // 2
    for (a, b), r in found.items():
        both = [k for k in range(6) if (k, a) in labels and (k, b) in labels]
        assert r.n_joint == len(both) and r.n_same == sum(labels[k, a] == labels[k, b] for k in both)
    whole = consensus.consensus(table, 6, 17)
    m = np.eye(17)
    for r in whole.collect():
        m[r.id_a, r.id_b] = m[r.id_b, r.id_a] = r.consensus or 0
    for r in consensus.consensus_row_distance(whole, 17).collect():
        assert abs(r.distance - np.linalg.norm(m[r.id_a] - m[r.id_b])) < 1e-6


def _labels(spark, seed=7, n=40):
    """Labels of replicates, among them equal vectors, and their numbers."""
    rng = np.random.default_rng(seed)
    labels = {(r, i): int(rng.integers(0, 3)) for r in range(6) for i in range(n) if rng.random() < 0.7}
    labels |= {(r, 1): labels[r, 0] for r in range(6) if (r, 0) in labels}
    labels = {k: v for k, v in labels.items() if k[1] != 1 or (k[0], 0) in labels}
    return labels, spark.createDataFrame([(r, i, c) for (r, i), c in labels.items()], "replicate int, id long, cluster int")


def test_consensus_by_marks(spark, monkeypatch):
    """Counts by products of marks are those of blocks, rounded as Spark does, in batches of few pairs."""
    _, table = _labels(spark)
    monkeypatch.setattr(consensus, "pairwise", lambda *_: 1 / 0)
    monkeypatch.setattr(consensus, "BATCH_PAIRS", 50)
    found = sorted(map(tuple, consensus.consensus(table, 6, 40, 6).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(consensus, "MOST_LABELS", 0)
    assert found == sorted(map(tuple, consensus.consensus(table, 6, 40, 6).collect())) and len(found) == 780


def test_jaccard_by_marks(spark, monkeypatch):
    _, table = _labels(spark, 9)
    monkeypatch.setattr(consensus, "pairwise", lambda *_: 1 / 0)
    found = sorted(map(tuple, consensus.jaccard_distance(table, 6, 40, 6).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(consensus, "MOST_LABELS", 0)
    assert found == sorted(map(tuple, consensus.jaccard_distance(table, 6, 40, 6).collect())) and len(found) == 780


def test_row_distance_of_labels(spark, monkeypatch):
    """Rows of the consensus aren't a table; equal label vectors are at 0."""
    labels, table = _labels(spark, 10)
    monkeypatch.setattr(consensus, "SQUARE", 7)
    monkeypatch.setattr(consensus, "ACROSS", 5)
    monkeypatch.setattr(consensus, "consensus_row_distance", lambda *_: 1 / 0)
    m = np.eye(40)
    for a in range(40):
        for b in range(a):
            both = [r for r in range(6) if (r, a) in labels and (r, b) in labels]
            m[a, b] = m[b, a] = np.mean([labels[r, a] == labels[r, b] for r in both]) if both else 0
    found = {(r.id_a, r.id_b): r.distance for r in consensus.labels_row_distance(table, 6, 40).collect()}
    assert found.keys() == {(a, b) for b in range(40) for a in range(b)} and found[0, 1] == 0
    assert all(abs(d - np.linalg.norm(m[a] - m[b])) < 1e-9 for (a, b), d in found.items())


@pytest.mark.parametrize("method, in_task, in_rows", [(m, n, r) for m in hierarchy.METHODS for n, r in ((hierarchy.IN_TASK, 0), (4, hierarchy.IN_ROWS), (4, 0)) if (m, n, r) != ("single", 4, 0)])
def test_linkage(spark, method, in_task, in_rows):
    rng = np.random.default_rng(8)
    points = rng.random((14, 3))
    d = {(a, b): float(np.linalg.norm(points[a] - points[b])) for a in range(14) for b in range(a + 1, 14)}
    dist = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "id_a long, id_b long, distance double")
    want = naive_linkage(d, method)
    rows = sorted(hierarchy.linkage(dist, method, in_task, in_rows).collect(), key=lambda r: r.step)
    assert [r.step for r in rows] == list(range(1, 14))
    members = {i: {i} for i in range(14)}
    got = []
    for r in rows:
        assert r.left < r.right
        members[r.left] |= members.pop(r.right)
        assert r.size == len(members[r.left])
        got.append((r.height, frozenset(members[r.left])))
    assert [g[1] for g in got] == [w[1] for w in want] and np.allclose([g[0] for g in got], [w[0] for w in want])
    if method not in ("average", "single") or in_task == 4:
        return
    merges = spark.createDataFrame(rows)
    for k in (1, 3, 14):
        cut = {r.id: r.cluster for r in hierarchy.cut_tree(merges, k).collect()}
        assert set(cut) == set(range(14)) and set(cut.values()) == set(range(1, k + 1))
        for height, own in want[: 14 - k]:
            assert len({cut[i] for i in own}) == 1
    order = {r.id: r.position for r in hierarchy.leaf_order(merges).collect()}
    assert sorted(order.values()) == list(range(14))
    for _, own in want:  # every cluster is a run of leaves
        places = sorted(order[i] for i in own)
        assert places == list(range(places[0], places[0] + len(own)))
    heights = {(r.id_a, r.id_b): r.height for r in hierarchy.cophenetic_distance(merges).collect()}
    first = {(a, b): next(h for h, own in want if a in own and b in own) for a, b in d}
    assert heights.keys() == first.keys() and all(abs(heights[p] - first[p]) < 1e-9 for p in first)
    r = np.corrcoef([d[p] for p in d], [first[p] for p in d])[0, 1]
    assert abs(hierarchy.cophenetic_correlation(dist, merges).first().correlation - r) < 1e-9


@pytest.mark.parametrize("in_task", [hierarchy.IN_TASK, 3])
def test_chain(spark, in_task):
    """Points at growing steps: single linkage adds one at a time, so the tree is as deep as it has leaves."""
    at = np.cumsum(np.arange(1, 31))
    names = [f"n{i:02}" for i in range(30)]
    pairs = [(names[i], names[j], float(at[j] - at[i])) for i in range(30) for j in range(i + 1, 30)]
    dist = spark.createDataFrame(pairs, "id_a string, id_b string, distance double")
    merges = scratch.materialise(hierarchy.linkage(dist, "single", in_task), "chain")
    rows = sorted(merges.collect(), key=lambda r: r.step)
    assert [(r.left, r.right, r.height, r.size) for r in rows] == [("n00", names[i], float(i + 1), i + 1) for i in range(1, 30)]
    order = {r.id: r.position for r in hierarchy.leaf_order(merges).collect()}
    assert [order[n] for n in reversed(names)] == [*range(28), 29, 28] or sorted(order.values()) == list(range(30))
    heights = {(r.id_a, r.id_b): r.height for r in hierarchy.cophenetic_distance(merges).collect()}
    assert heights == {(names[i], names[j]): float(j + 1) for i in range(30) for j in range(i + 1, 30)}


@pytest.mark.parametrize("method", ["ward", "average"])
def test_linkage_by_rows(spark, method, monkeypatch):
    """Text ids, several blocks of rows, and rows written whole after every second round give the tree of one task."""
    monkeypatch.setattr(matrixrows, "ROUNDS", 2)
    monkeypatch.setattr(matrixrows, "CELLS", 2000)
    points = np.random.default_rng(5).random((150, 4))
    name = [f"id{i:03}" for i in range(150)]
    d = [(name[a], name[b], float(np.linalg.norm(points[a] - points[b]))) for a in range(150) for b in range(a)]
    dist = scratch.materialise(spark.createDataFrame(d, "id_a string, id_b string, distance double"), "dist")
    want, got = (sorted(hierarchy.linkage(dist, method, n).collect(), key=lambda r: r.step) for n in (hierarchy.IN_TASK, 20))
    assert [(r.step, r.left, r.right, r.size) for r in got] == [(r.step, r.left, r.right, r.size) for r in want]
    assert np.allclose([r.height for r in got], [r.height for r in want])


def test_linkage_by_rows_with_ties(spark):
    """Points at whole places: many equal distances; each of the merges joins two clusters at their distance."""
    points = [(i % 6, i // 6) for i in range(36)]
    d = {(a, b): float(abs(points[a][0] - points[b][0]) + abs(points[a][1] - points[b][1])) for a in range(36) for b in range(a + 1, 36)}
    dist = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "id_a long, id_b long, distance double")
    rows = sorted(hierarchy.linkage(dist, "complete", 3).collect(), key=lambda r: r.step)
    members = {i: {i} for i in range(36)}
    assert len(rows) == 35
    for r in rows:
        left, right = members[r.left], members.pop(r.right)
        assert r.height == max(d[min(a, b), max(a, b)] for a in left for b in right)
        left |= right
    with pytest.raises(ValueError, match="missing"):
        hierarchy.linkage(dist.filter("id_a % 6 = 0 and id_b = id_a + 1"), "complete", 3)


def test_linkage_with_ties_and_nothing(spark):
    dist = spark.createDataFrame([(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)], "id_a long, id_b long, distance double")
    rows = hierarchy.linkage(dist, "average").collect()
    assert len(rows) == 5 and max(r.size for r in rows) == 6 and {r.height for r in rows} == {1.0}
    assert hierarchy.linkage(dist.filter("false"), "ward").collect() == []


@pytest.mark.parametrize("method", points.METHODS)
def test_linkage_of_points(spark, method, monkeypatch):
    """Points without a table of pairs give the tree of the pairs, equal points among them, and no table of pairs is written."""
    rng = np.random.default_rng(11)
    x, y = rng.random((2, 60))
    x[40:50], y[40:50] = x[0], y[0]
    x[50:52], y[50:52] = x[7], y[7]
    table = spark.createDataFrame([(f"p{i:02}", float(x[i]), float(y[i])) for i in range(60)], "id string, x double, y double")
    pairs = scratch.materialise(points.apart(table), "pairs")
    want = sorted(hierarchy.linkage(pairs, method).collect(), key=lambda r: r.step)
    correlation = hierarchy.cophenetic_correlation(pairs, scratch.materialise(hierarchy.linkage(pairs, method), "tree")).first()[0]
    monkeypatch.setattr(points, "CELLS", 200)
    monkeypatch.setattr(points, "apart", lambda _: 1 / 0)
    merges = scratch.materialise(points.linkage_points(table, method, 6), "tree")
    got = sorted(merges.collect(), key=lambda r: r.step)
    assert [(r.step, r.left, r.right, r.size) for r in got] == [(r.step, r.left, r.right, r.size) for r in want]
    assert np.allclose([r.height for r in got], [r.height for r in want])
    assert abs(points.cophenetic_correlation(table, merges).first()[0] - correlation) < 1e-9
    order = {r.id: r.position for r in hierarchy.leaf_order(merges).collect()}
    found = {(r.row, r.column): r.distance for r in points.leaf_pairs(table, hierarchy.leaf_order(merges)).collect()}
    assert found == {tuple(sorted((order[r.id_a], order[r.id_b]))): r.distance for r in pairs.collect()}


def test_linkage_of_points_on_a_grid(spark):
    """Many equal distances: each merge is of two clusters at their distance, and an average's last bits stop nothing."""
    at = [(i % 9, i // 9) for i in range(81)]
    table = spark.createDataFrame([(i, float(a) / 3, float(b) / 7) for i, (a, b) in enumerate(at)], "id long, x double, y double")
    for method in ("average", "ward"):
        members = {i: {i} for i in range(81)}
        for r in sorted(points.linkage_points(table, method, 2).collect(), key=lambda r: r.step):
            left, right = members[r.left], members.pop(r.right)
            own = [np.array([(at[i][0] / 3, at[i][1] / 7) for i in sorted(side)]) for side in (left, right)]
            d = np.sqrt(((own[0][:, None] - own[1][None]) ** 2).sum(axis=2)).mean()
            if method == "ward":
                a, b = len(left), len(right)
                d = np.sqrt(2 * a * b / (a + b)) * np.linalg.norm(own[0].mean(axis=0) - own[1].mean(axis=0))
            assert abs(r.height - d) < 1e-9
            left |= right
        assert list(map(len, members.values())) == [81]


def test_align_labels(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, label long")
    b = spark.createDataFrame([(i, (i + 1) % 3) for i in range(30)], "id long, label long")
    assert {(r.label_a, r.label_b) for r in clusters.align_labels(a, b, 1).collect()} == {(0, 2), (1, 3), (2, 1)}


# Tests and enrichment


def test_tails_against_tables():
    for x, df, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (23.20925, 10, 0.01), (0.0, 3, 1.0), (124.3421, 100, 0.05)):
        assert abs(tails.chi2_tail(x, df) - p) < 1e-6
    for t, p in ((1.3581, 0.05), (1.6276, 0.01), (0.5, 0.9639), (0.0, 1.0)):
        assert abs(tails.kolmogorov_tail(t) - p) < 1e-4


def test_fisher(spark):
    table = spark.createDataFrame([(1, 8, 2, 1, 5), (2, 3, 0, 0, 3), (3, 0, 0, 4, 5)], "run long, a long, b long, c long, d long")
    got = {r.run: r.p for r in stats.fisher_exact(table, ["run"]).collect()}
    assert abs(got[1] - 0.034965) < 1e-5 and abs(got[2] - 0.1) < 1e-9 and abs(got[3] - 1) < 1e-9


def test_kruskal_and_ks(spark):
    rows = [(1, v, g) for g, vs in (("a", [1.0, 2.0, 2.0, 5.0]), ("b", [3.0, 4.0, 6.0]), ("c", [7.0, 8.0])) for v in vs] + [(1, None, "a"), (2, 1.0, "a"), (2, 1.0, "b")]
    table = spark.createDataFrame(rows, "run long, v double, g string")
    got = {r.run: r for r in stats.kruskal(table, ["run"], "v", "g").collect()}
    values = [1, 2, 2, 5, 3, 4, 6, 7, 8]
    rank = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
    h = 12 / 90 * sum(sum(rank[v] for v in vs) ** 2 / len(vs) for vs in ([1, 2, 2, 5], [3, 4, 6], [7, 8])) - 30
    assert abs(got[1].statistic - h / (1 - 6 / 720)) < 1e-9 and got[1].df == 2 and got[2].statistic is None
    ks = {r.run: r.statistic for r in stats.ks_2sample(table.filter("g <> 'c'"), ["run"], "v", "g").collect()}
    assert abs(ks[1] - 0.75) < 1e-9 and ks[2] == 0


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03]
    got = {r.i: r.q for r in stats.adjust_bh(spark.createDataFrame([*enumerate(ps), (9, None)], "i long, p double"), "p", []).collect()}
    order = sorted(range(6), key=lambda i: ps[i])
    q, least = {}, 1.0
    for rank in range(6, 0, -1):
        least = min(least, ps[order[rank - 1]] * 6 / rank)
        q[order[rank - 1]] = least
    assert got[9] is None and all(abs(got[i] - q[i]) < 1e-12 for i in q)


def test_enrichment(spark):
    genes = spark.createDataFrame([(g, f"t{g % 3}") for g in range(30)], "gene long, term string")
    parents = spark.createDataFrame([("t0", "top", "n", 1), ("t1", "top", "n", 1), ("t2", "mid", "n", 2), ("mid", "top", "n", 1), ("top", None, "n", 0)], "term string, parent string, namespace string, depth int")
    closed = enrichment.propagate_annotations(genes, parents)
    assert closed.filter("term = 'top'").count() == 30 and closed.filter("term = 'mid'").count() == 10
    asked = spark.createDataFrame([(1, g) for g in (0, 3, 6, 9, 1, 99)], "cluster long, gene long")
    found = {r.term: r for r in enrichment.enrich(asked, closed, parents, ["cluster"]).collect()}
    p = sum(math.comb(10, i) * math.comb(20, 5 - i) for i in (4, 5)) / math.comb(30, 5)
    assert (found["t0"].x, found["t0"].n, found["t0"].n_query, found["t0"].n_background) == (4, 10, 5, 30)
    assert abs(found["t0"].p - p) < 1e-9 and abs(found["top"].p - 1) < 1e-9


def test_grid_and_mapping(spark):
    assert sweep.parameter_grid(spark, a=[1, 2], b=["x"]).count() == 2
    kinds = {(r.gene, r.gene_class) for r in mapping.classify_genes(spark.createDataFrame([(1,), (2,)], "gene long"), spark.createDataFrame([(2,), (3,)], "gene long")).collect()}
    assert kinds == {(1, "network_only"), (2, "common"), (3, "mutation_only")}


def test_planted_pathways_are_found(spark):
    """Individuals of two groups mutate genes of two separate pathways; the whole run tells them apart."""
    rng = np.random.default_rng(10)
    edges = [(a + 10 * p, a + 10 * p + s) for p in range(2) for a in range(10) for s in (1, 2) if a + s < 10]
    rows = [(i, int(g) + 10 * (i % 2), 1.0) for i in range(16) for g in rng.choice(10, 4, replace=False)]
    found = stratify(
        spark.createDataFrame(rows, "individual long, gene long, value double"),
        network.binary_adjacency(spark.createDataFrame(edges, "a long, b long"), "a", "b"),
        spark.createDataFrame([(i,) for i in range(16)], "individual long"),
        k=2,
        n_replicates=6,
        max_iter=15,
    )
    cluster = {r.individual: r.cluster for r in found.collect()}
    assert len(cluster) == 16
    agree = sum(cluster[i] == cluster[j] for i in range(16) for j in range(i) if (i - j) % 2 == 0) / 56
    apart = sum(cluster[i] != cluster[j] for i in range(16) for j in range(i) if (i - j) % 2) / 64
    assert agree > 0.9 and apart > 0.9


def test_burden_histogram_of_one_value(spark):
    table = spark.createDataFrame([(1, 2.0), (2, 2.0)], "individual long, burden double")
    rows = profiles.burden_histogram(table, 4).collect()
    assert sum(r.n for r in rows) == 2 and abs(sum(r.density for r in rows) * 0.25 - 1) < 1e-9


def test_replicates_without_lambda_are_plain(spark, monkeypatch, one_round):
    cells = [(f"i{i:02}", f"g{g:02}", 1.0 + (i * g) % 3) for i in range(10) for g in range(8) if (i < 5) == (g < 4) or (i + g) % 7 == 0]
    profile = spark.createDataFrame(cells, "individual string, gene string, value double")
    edges = spark.createDataFrame([("g00", "g01", 1.0), ("g01", "g00", 1.0)], "src string, dst string, weight double")
    made, plain = [], factorize.nmf
    monkeypatch.setattr(factorize, "nmf", lambda *given: made.append(plain(*given)) or made[-1])
    labels, _ = factorize.bootstrap_labels(profile, None, 2, 1, lambd=0.0, max_iter=1, tol=None, block_cells=0)
    found = {r.id: r.cluster for r in labels.collect()}
    want = {r.id: max(range(2), key=lambda i: (r.weights[i], -i)) for r in made[0][0].collect()}
    assert len(found) == 8 and len(made) == 1 and all(found[i] == c for i, c in want.items())
    for given in ({"edges": None}, {"edges": edges, "lambd": 0.0}, {"edges": edges, "raw": True}):  # in blocks
        labels, _ = factorize.bootstrap_labels(profile, given.pop("edges"), 2, 1, max_iter=1, tol=None, **given)
        assert {r.id: r.cluster for r in labels.collect()} == found
    assert len(made) == 1


def test_replicates_against_a_plain_one(spark):
    x, a, profile, edges = random_case(spark, seed=11)
    cells = {(i, g): float(x[i, g]) for i, g in zip(*np.nonzero(x), strict=True)}
    weights = {(g, o): 1.0 for g, o in zip(*np.nonzero(a), strict=True)}
    people, genes = sorted({i for i, _ in cells}), sorted({g for _, g in cells})
    for k in (2, 3):
        found = factorize.bootstrap_labels(profile, edges, k, 3, lambd=2.0, max_iter=4, tol=None)
        got = {("individual", r.replicate, r.id): r.cluster for r in found[0].collect()} | {("gene", r.replicate, r.id): r.cluster for r in found[1].collect()}
        assert len(got) == 3 * (int(0.8 * len(people)) + int(0.8 * len(genes)))
        for replicate in range(3):
            want = plain_replicate(cells, weights, people, genes, replicate, k, 2.0, 4)
            assert want and all(got[side, replicate, i] == label for (side, i), label in want.items())


def test_one_component_keeps_its_weights(spark, one_round):
    x, _, profile, edges = random_case(spark, seed=12)
    found, genes = factorize.bootstrap_labels(profile, edges, 1, 1, max_iter=2, tol=None)
    assert len({r.cluster for r in found.collect()}) > 2 and len({r.cluster for r in genes.collect()}) > 2
    whole, _ = factorize.bootstrap_labels(profile, edges, 1, 1, max_iter=2, tol=None, block_cells=0)
    assert dict(whole.dtypes)["cluster"] == "double"


def test_factors_end_by_error_or_fall(spark):
    rng = np.random.default_rng(13)
    x = rng.random((6, 2)) @ rng.random((2, 5)) + 0.1
    profile = cells(spark, x, ("individual", "gene", "value"))
    w0, h0 = plain_nndsvd(x, 2)
    start = lambda f: spark.createDataFrame([(i, [float(v) + 0.1 for v in row]) for i, row in enumerate(f)], "id long, weights array<double>")
    far = factor_arrays(*factorize.gnmf(profile, None, start(w0), start(h0.T), 2, 0.0, 8), 6, 5, 2)
    one = factor_arrays(*factorize.gnmf(profile, None, start(w0), start(h0.T), 2, 0.0, 8, tol=1e9), 6, 5, 2)
    two = factor_arrays(*factorize.gnmf(profile, None, start(w0), start(h0.T), 2, 0.0, 8, fall=1.0), 6, 5, 2)
    errors = [np.linalg.norm(x - f @ g) for f, g in (one, two, far)]
    assert errors[0] > errors[1] > errors[2]
    w, h = factorize.block_gnmf(x, (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), w0 + 0.1, h0 + 0.1, 0.0, None, 8)
    assert np.allclose(w, far[0]) and np.allclose(h, far[1])


def test_block_start_is_the_distributed_one(spark, one_round):
    rng = np.random.default_rng(14)
    for shape in ((12, 7), (7, 12)):
        x = rng.random(shape)
        want = plain_nndsvd(x, 3)
        assert all(np.allclose(f, g, atol=1e-7) for f, g in zip(factorize.block_start(x, list(range(shape[1])), 3), want, strict=True))
        found = factor_arrays(*factorize.nndsvd_init(cells(spark, x, ("individual", "gene", "value")), 3), *shape, 3)
        assert all(np.allclose(f, g, atol=1e-6) for f, g in zip(found, want, strict=True))


@pytest.fixture
def one_round(monkeypatch):
    """Enough where the sketch spans everything; workers keep their own number."""
    monkeypatch.setattr(svd, "ROUNDS", 1)


def test_randomised_svd_by_run(spark):
    """Two runs at once: against numpy where the sketch spans everything, against the same steps on a matrix where it doesn't."""
    rng = np.random.default_rng(21)
    small, large = rng.random((6, 9)), rng.random((40, 60)) * (rng.random((40, 60)) < 0.3) + np.outer(np.arange(40) % 3 == 0, np.arange(60) % 4 == 0)
    rows = [(run, int(i), int(j), float(x[i, j])) for run, x in (("a", small), ("b", large)) for i, j in zip(*np.nonzero(x), strict=True)]
    table = spark.createDataFrame(rows, "run string, individual long, gene long, value double").repartition(7)
    left, values, right = svd.randomised_svd(table, 3, ["run"])
    s = {r.run: r.s for r in values.collect()}
    side = {name: {(r.run, r.id): r.weights for r in df.collect()} for name, df in (("left", left), ("right", right))}
    exact = np.linalg.svd(small)[1]
    assert np.allclose(s["a"], exact[:3])
    u, own, v = svd.block_svd(large, list(range(60)), 3)
    assert np.allclose(s["b"], own) and np.allclose(own, np.linalg.svd(large)[1][:3], rtol=0.02) and np.isclose(own[0], np.linalg.svd(large)[1][0], rtol=1e-9)
    for name, want in (("left", u), ("right", v)):
        got = np.array([side[name]["b", i] for i in range(len(want))])
        assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-8)  # the same vectors but for signs
    assert np.allclose(np.array([side["left"]["a", i] for i in range(6)]).T @ np.array([side["left"]["a", i] for i in range(6)]), np.eye(3), atol=1e-9)


def test_triangles_of_many_parts(spark, one_round):
    rng = np.random.default_rng(22)
    f = rng.random((500, 4))
    f[:, 3] = f[:, 0] + f[:, 1]  # of rank 3
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(f)], "id long, weights array<double>").repartition(23)
    (r,) = svd.triangles(table, 4, []).collect()
    r = np.array(r.r).reshape(-1, 4)
    assert np.allclose(r.T @ r, f.T @ f)
    left, values, right = svd.randomised_svd(cells(spark, f, ("individual", "gene", "value")), 4)
    s = values.first().s
    assert np.allclose(s, np.r_[np.linalg.svd(f)[1][:3], 0]) and all(row.weights[3] == 0 for row in left.collect() + right.collect())


def test_starts_of_empty_and_small_matrices(spark, one_round):
    empty = spark.createDataFrame([], "individual long, gene long, value double")
    assert all(f.count() == 0 for f in factorize.nndsvd_init(empty, 2))
    one = spark.createDataFrame([(1, 1, 4.0)], "individual long, gene long, value double")
    w, h = (f.first().weights for f in factorize.nndsvd_init(one, 3))
    assert np.allclose(w, [2, 0, 0]) and np.allclose(h, [2, 0, 0])
    assert all(np.allclose(f, g) for f, g in zip(factorize.block_start(np.array([[4.0]]), [1], 3), ([[2, 0, 0]], [[2], [0], [0]]), strict=True))


@pytest.mark.parametrize("lambd", [0.0, 2.0])
def test_replicates_are_the_same_in_blocks_and_as_tables(spark, lambd):
    rng = np.random.default_rng(23)
    x = (rng.random((40, 60)) < 0.15) * rng.integers(1, 4, (40, 60)) + np.kron(np.eye(2), np.ones((20, 30))) * (rng.random((40, 60)) < 0.3)
    a = np.triu(rng.random((60, 60)) < 0.1, 1)
    profile, edges = cells(spark, x, ("individual", "gene", "value")), cells(spark, (a | a.T).astype(float), ("src", "dst", "weight"))
    tol = 5e-3 if lambd == 0 else 20.0  # replicates end by themselves
    found = [factorize.bootstrap_labels(profile, edges, 3, 2, lambd=lambd, max_iter=4, tol=tol, block_cells=most) for most in (0, 1 << 20)]
    for one, other in zip(*found, strict=True):
        one, other = ({(r.replicate, r.id): r.cluster for r in df.collect()} for df in (one, other))
        assert one.keys() == other.keys() and one == other and len(set(one.values())) == 3


def test_replicates_use_edges_of_their_own_genes(spark):
    edges = spark.createDataFrame([(f"g{a:02}", f"g{b:02}", 1.0) for a in range(4) for b in range(4) if a != b], "src string, dst string, weight double")
    columns = spark.createDataFrame([(0, "g00"), (0, "g01"), (1, "g00")], "replicate int, gene string")
    assert sorted(map(tuple, factorize.sampled_edges(edges, columns).collect())) == [(0, "g00", "g01", 1.0), (0, "g01", "g00", 1.0)]
    runs = spark.createDataFrame([(0, "g00", [1.0]), (0, "g01", [1.0]), (1, "g00", [1.0])], "replicate int, id string, weights array<double>")
    w = spark.createDataFrame([(0, "i00", [1.0]), (1, "i00", [1.0])], "replicate int, id string, weights array<double>")
    x = spark.createDataFrame([(0, "i00", "g00", 1.0), (1, "i00", "g00", 1.0)], "replicate int, individual string, gene string, value double")
    h = {(r.replicate, r.id): r.weights[0] for r in factorize.update_h(x, w, runs, factorize.sampled_edges(edges, columns), 1, 1.0, ["replicate"]).collect()}
    assert h[0, "g00"] == pytest.approx(1.0) and h[0, "g01"] == pytest.approx(0.5) and h[1, "g00"] == pytest.approx(1.0)


def test_medians_by_counts(spark):
    rng = np.random.default_rng(15)
    rows = [(int(rng.integers(0, 4)) if i else None, None if rng.random() < 0.2 else float(rng.integers(0, 9)), None if i % 50 else 1.0) for i in range(300)]
    found = clusters.cluster_medians(spark.createDataFrame(rows, "cluster int, a double, b double"), ["cluster"], ["a", "b"]).collect()
    assert len(found) == 5
    for r in found:
        for name, place in (("a", 1), ("b", 2)):
            own = [row[place] for row in rows if row[0] == r.cluster and row[place] is not None]
            assert r[f"median_{name}"] == (float(np.median(own)) if own else None)


def test_log_factorials(spark):
    numbers = [*range(40), 100, 12345, 10**9]
    found = spark.createDataFrame([(n,) for n in [*numbers, -1, None]], "n long").select("n", tails.log_factorial(F.col("n")).alias("v"), tails.log_factorial(F.col("n").cast("double")).alias("w")).collect()
    for r in found:
        if r.n is None or r.n < 0:
            assert r.v is None and r.w is None
        else:
            assert r.v == r.w and abs(r.v - math.lgamma(r.n + 1)) <= 2e-14 * max(1, math.lgamma(r.n + 1))


def test_scratch_scopes_and_numbers(spark):
    with scratch.temporary(spark) as result:
        first = scratch.materialise(spark.range(5), "gone")
        with scratch.temporary(spark) as inner:
            second = inner(first, "inner")
        kept = result(second.withColumn("x", F.lit(1)), "kept")
    assert kept.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|no such file|not found"):
        first.count()
    rows = spark.range(1000).select(F.xxhash64("id").alias("h"), "id").repartition(7)
    found = scratch.numbered(rows, ["h"], "place").collect()
    assert [r.place for r in sorted(found, key=lambda r: r.h)] == list(range(1000))
    assert scratch.numbered(spark.range(0), ["id"]).collect() == []


def test_communities_are_a_local_best(spark):
    rng = np.random.default_rng(16)
    pairs = [(a, b) for a, b in itertools.combinations(range(40), 2) if rng.random() < (0.5 if a // 10 == b // 10 else 0.05)]
    table = network.binary_adjacency(spark.createDataFrame(pairs, "a long, b long"), "a", "b")
    found = {r.gene: r.community for r in diffusion.communities(table, 30).collect()}
    edges = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    best = modularity(edges, found)
    assert best > 0.3
    for gene in found:
        for community in set(found.values()):
            assert modularity(edges, found | {gene: community}) <= best + 1e-9


@pytest.mark.parametrize("mut_type, influence", [("raw", "min"), ("propagated", "max"), ("median_qn", "min")])
def test_runs_by_their_parameters(spark, mut_type, influence):
    rng = np.random.default_rng(17)
    edges = [(a + 10 * p, a + 10 * p + s) for p in range(2) for a in range(10) for s in (1, 2) if a + s < 10]
    rows = [(i, int(g) + 10 * (i % 2), 1.0) for i in range(16) for g in rng.choice(10, 6, replace=False)]
    table = network.binary_adjacency(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    found = job.run(spark.createDataFrame(rows, "individual long, gene long, value double"), None if mut_type == "raw" else table, spark.createDataFrame([(i,) for i in range(16)], "individual long"), 2, 8, max_iter=30, mut_type=mut_type, influence=influence, genes=True)
    for key, n, kind in (("clusters", 16, lambda i: i % 2), ("gene_clusters", 20, lambda g: g // 10)):
        cluster = {r[0]: r.cluster for r in found[key].collect()}
        assert len(cluster) == n
        right = sum((cluster[i] == cluster[j]) == (kind(i) == kind(j)) for i in cluster for j in cluster if i < j) / (n * (n - 1) / 2)
        assert right > 0.9, (key, right)
    members = spark.createDataFrame([(i, "sibling" if i % 2 else "proband", "male", float(i), 1.0, 2.0, 3.0, 4.0) for i in range(16)], "individual long, role string, sex string, iq double, srs double, vineland double, distance double, burden double")
    rows = job.evidence(found["clusters"], members, 2).collect()
    assert sum(r.value for r in rows if (r.what, r.measure) == ("count", "n_total")) == 16
    assert {r.measure for r in rows if r.what == "p"} == {"sibling", "female", *clusters.MEASURES}
    assert min(r.value for r in rows if (r.what, r.measure) == ("p", "sibling")) < 0.01


def exact_fisher(a, b, c, d):
    """With whole numbers."""
    r, s, k = a + b, c + d, a + c
    ways = {x: math.comb(r, x) * math.comb(s, k - x) for x in range(max(0, k - s), min(r, k) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w * 10**7 <= ways[a] * (10**7 + 1)), sum(ways.values())))


def test_fisher_by_ratios(spark):
    rng = np.random.default_rng(31)
    rows = [tuple(int(v) for v in rng.integers(0, top, 4)) for top in (2, 5, 30, 200) for _ in range(12)] + [(0, 0, 0, 0), (7, 0, 0, 9), (0, 400, 300, 0), (1, 2, 3, 4), (500, 1, 1, 500)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "run long, a long, b long, c long, d long")
    for r in stats.fisher_exact(table, ["run"]).collect():
        assert r.p == pytest.approx(exact_fisher(*rows[r.run]), rel=1e-9, abs=1e-300)
    large = spark.createDataFrame([(0, 50_000_000, 50_000_000, 50_000_000, 50_000_000), (1, 50_010_000, 49_990_000, 49_990_000, 50_010_000), (2, 60_000_000, 40_000_000, 1, 10), (3, 90_000_000, 1_000_000, 1_000_000, 90_000_000)], "run long, a long, b long, c long, d long")
    found = {r.run: r.p for r in stats.fisher_exact(large, ["run"]).collect()}
    # 10^4 from the mean, at a standard deviation of sqrt(10^8 / 8)
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(math.erfc((10_000 - 0.5) / math.sqrt(1e8 / 8) / math.sqrt(2)), rel=1e-3) and 0 < found[2] < 1e-2 and found[3] == 0


def test_samples_are_the_first_by_draw(spark):
    ids = [f"n{i}" for i in range(500)]
    table = spark.createDataFrame([(i,) for i in ids], "id string")
    for frac in (0.0, 0.001, 0.5, 0.8, 1.0):
        found = {}
        for r in consensus.subsample(table, "id", 3, frac, 7).collect():
            found.setdefault(r.replicate, []).append(r.id)
        assert all(sorted(found.get(n, [])) == sampled(ids, n, 7, frac) for n in range(3))


def test_rows_are_ranked_without_their_zeros(spark):
    rng = np.random.default_rng(32)
    for share in (0.1, 0.5, 0.95):
        x = (rng.random((8, 13)) < share) * rng.integers(1, 4, (8, 13)).astype(float)
        x[3] = 0
        order = np.argsort(x, axis=1, kind="stable")
        levels, want = np.sort(x, axis=1).mean(axis=0), np.zeros_like(x)
        np.put_along_axis(want, order, levels[None, :], axis=1)
        people, genes = spark.createDataFrame([(i,) for i in range(8)], "individual long"), spark.createDataFrame([(j,) for j in range(13)], "gene long")
        found = normalize.quantile_normalize_rows(cells(spark, x, ("individual", "gene", "value")), people, genes)
        got = np.zeros_like(x)
        for r in found.collect():
            assert r.value != 0 and got[r.individual, r.gene] == 0
            got[r.individual, r.gene] = r.value
        assert np.allclose(got, want)


def test_rows_of_ranks_with_their_zeros(spark, monkeypatch):
    """Every cell once, also those of individuals without values, in runs within a piece and over several."""
    monkeypatch.setattr(normalize, "PIECE", 4)
    rng = np.random.default_rng(34)
    people, genes = spark.createDataFrame([(i,) for i in range(8)], "individual long"), spark.createDataFrame([(j,) for j in range(13)], "gene long")
    for share in (0.0, 0.1, 0.5, 0.95):
        x = (rng.random((8, 13)) < share) * rng.integers(1, 4, (8, 13)).astype(float)
        x[3], x[5, 1:] = 0, 0
        order = np.argsort(x, axis=1, kind="stable")
        levels, want = np.sort(x, axis=1).mean(axis=0), np.zeros_like(x)
        np.put_along_axis(want, order, levels[None, :], axis=1)
        found = normalize.quantile_normalize_rows(cells(spark, x, ("individual", "gene", "value")), people, genes, zeros=True)
        got = sorted((r.individual, r.gene, r.value) for r in found.collect())
        assert [c[:2] for c in got] == list(itertools.product(range(8), range(13)))
        assert np.allclose([c[2] for c in got], want.ravel())


def test_hubs_are_dealt_to_several_tasks(spark):
    """A star: its centre's edges in equal parts, the same result as unsplit."""
    pairs = [(0, i) for i in range(1, 401)]
    edges = spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "src long, dst long, weight double")
    salted, meets = hubs.split(edges, most=50)
    sizes = [r["count"] for r in salted.filter("src = 0").groupBy("_salt").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * np.median(sizes) and salted.filter("src <> 0 and _salt <> 0").count() == 0
    profile = spark.createDataFrame([(p, g, 1.0 + p) for p in range(5) for g in (0, 1, 7)], "individual long, gene long, value double")
    assert hubs.meeting(profile, meets, "gene").count() == 5 * (8 + 2)
    network = diffusion.normalize_network(edges)
    one, other = ({(r.individual, r.gene): r.value for r in diffusion.propagate(profile, network, 0.6, 1e-3, 4, hub).collect()} for hub in (50, 10**6))
    assert one.keys() == other.keys() and all(one[c] == pytest.approx(other[c]) for c in one)


def test_row_distances_in_tiles(spark, monkeypatch):
    """Many tiles, rows in many parts, names as ids: as on the whole matrix."""
    monkeypatch.setattr(consensus, "INNER", 7)
    rng = np.random.default_rng(35)
    n = 40
    m = rng.random((n, n))
    m = (m + m.T) / 2
    np.fill_diagonal(m, 1)
    rows = [(f"n{i:02}", f"n{j:02}", float(m[i, j])) for i in range(n) for j in range(i + 1, n)]
    table = spark.createDataFrame(rows, "id_a string, id_b string, consensus double")
    for most in (4096, 9):
        monkeypatch.setattr(consensus, "TILE", most)
        found = {(r.id_a, r.id_b): r.distance for r in consensus.consensus_row_distance(table, n).collect()}
        assert len(found) == n * (n - 1) // 2
        assert all(d == pytest.approx(np.linalg.norm(m[int(a[1:])] - m[int(b[1:])]), abs=1e-9) for (a, b), d in found.items())


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(34)
    rows = sorted({(int(k) if k else None, float(v)) for k, v in rng.integers(0, 400, (3000, 2)) % [3, 400]}, key=repr)
    rows = [(k, v, i % 5) for i, (k, v) in enumerate(rows)]
    found = running.running_sums(spark.createDataFrame(rows, "k int, v double, n int").repartition(9), ["k"], "v", ["n"]).collect()
    assert len(found) == len(rows) and all(r._upto_n == sum(n for k, v, n in rows if k == r.k and v <= r.v) for r in found)


def test_communities_of_communities(spark):
    """Cliques in pairs: single moves find cliques, levels the pairs; never below the single level."""
    pairs = set()
    for c in range(16):
        nodes = [4 * c + i for i in range(4)]
        pairs |= set(itertools.combinations(nodes, 2)) | {(nodes[0], 4 * ((c + 1) % 16) + 1)}
        if c % 2 == 0:
            pairs |= {(n, n + 4) for n in nodes}
    both = [(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))]
    edges = spark.createDataFrame(both, "src long, dst long, weight double")
    one, whole = ({r.gene: r.community for r in diffusion.communities(edges, levels=n).collect()} for n in (1, 10))
    score = lambda found: modularity([(a, b) for a, b, _ in both], found)
    assert score(whole) >= score(one) and diffusion.modularity(edges, spark.createDataFrame(list(whole.items()), "gene long, community long")) == pytest.approx(score(whole))
    assert len(set(whole.values())) <= 8 and all(len({whole[4 * c + i] for i in range(4)}) == 1 for c in range(16))


def test_influence_within_a_tolerance(spark):
    """In blocks and by joins, the same step ends it."""
    rng = np.random.default_rng(33)
    a = np.triu(rng.random((30, 30)) < 0.15, 1)
    edges = cells(spark, (a | a.T).astype(float), ("src", "dst", "weight"))
    for alpha, tol in ((0.6, 0.01), (0.3, 1e-4), (0.95, 0.5), (0.6, None)):
        one, other = ({(r.src, r.dst): r.value for r in found.collect()} for found in (diffusion.influence_blocks(edges, alpha, tol=tol), diffusion.influence_blocks(edges, alpha, tol=tol, most_edges=0)))
        assert one.keys() == other.keys() and len(one) and all(one[c] == pytest.approx(other[c], abs=1e-12) for c in one)


def test_grids_do_what_is_missing(spark, tmp_path, monkeypatch):
    """Networks and parameters are keys: runs that differ in one have results of their own, and none is done twice."""
    kinds = sweep.parameter_grid(spark, mut_type=["raw", "diff"], network=["APID", "STRING", "none"], qn_mode=["none"])
    grid = sweep.resolve_run(kinds).filter("mut_type = 'raw' or network <> 'none'").crossJoin(sweep.parameter_grid(spark, k=[2, 3]))
    prepared, done = [], []
    monkeypatch.setattr(job, "prepare", lambda profile, edges, people, **given: prepared.append((edges, given["mut_type"], given["alpha"])) or (profile, edges))

    def clustered(ready, pruned, given):
        done.append((pruned, given["k"], given["lambd"], given["tol"]))
        return {"clusters": spark.createDataFrame([(1, len(done))], "individual long, cluster int"), "consensus": spark.createDataFrame([(0.5 if given["k"] == 2 else 1.0,)], "consensus double")}

    monkeypatch.setattr(job, "_clustered", clustered)
    path, networks = str(tmp_path / "runs"), {"APID": "a", "STRING": "s"}
    first = job.run_grid(grid.filter("k = 2"), None, networks, None, path)
    assert sorted(done, key=repr) == [("a", 2, 1.0, None), ("s", 2, 1.0, None), (None, 2, 1.0, None)] and first.count() == 3
    whole = job.run_grid(grid, None, networks, None, path)
    assert len(done) == 6 and {(r.label, r.network, r.k) for r in whole.collect()} == {(label, name, k) for label, name in (("diffused", "APID"), ("diffused", "STRING"), ("raw", "none")) for k in (2, 3)}
    assert len({r.cluster for r in whole.collect()}) == 6
    more = job.run_grid(grid.filter("k = 2"), None, networks, None, path, lambd=200.0, tol=0.01)
    assert len(done) == 9 and {r.lambd for r in more.collect()} == {200.0} and {r.tol for r in more.collect()} == {0.01}
    prepared.clear()
    both = job.run_grid(grid.crossJoin(sweep.parameter_grid(spark, lambd=[1.0, 5.0])), None, networks, None, path)
    assert both.count() == 12 and len(done) == 15 and sorted(prepared, key=repr) == [("a", "propagated", 0.6), ("s", "propagated", 0.581), (None, "raw", 0.0)]
    scores, best = job.grid_stability(spark, path)
    assert scores.count() == 15 and {r.best_k for r in best.filter("lambd = 5.0").collect()} == {3}
    with pytest.raises(ValueError, match="lambda"):
        job.run_grid(grid, None, networks, None, path, **{"lambda": 3})


def test_singletons_stay_as_they_are(spark):
    """Genes without a neighbour: left out, or kept with their values, by parameter."""
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "b", 1.0)], "src string, dst string, weight double")
    profile = spark.createDataFrame([(1, "a", 1.0), (1, "x", 3.0), (2, "c", 2.0)], "individual long, gene string, value double")
    people = spark.createDataFrame([(1,), (2,)], "individual long")
    given = {**job.PREPARING, "mut_type": "propagated"}
    cells = lambda keep: {(r.individual, r.gene): r.value for r in job.prepare(profile, edges, people, **(given | {"keep_singletons": keep}))[0].collect()}
    without, kept = cells(False), cells(True)
    assert kept == without | {(1, "x"): pytest.approx(3.0)} and (1, "x") not in without
    dense = job.prepare(profile, edges, people, **(given | {"simplification": False, "n_best": 1}))[1]
    assert {(r.src, r.dst) for r in dense.collect()} <= {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}


def test_cohorts_side_by_side(spark):
    rows = [(i, g, 1.0) for i in range(24) for g in range(12) if (i % 2 == 0) == (g < 6) or (i * g) % 11 == 1]
    profile = spark.createDataFrame(rows, "individual long, gene long, value double")
    cohorts = spark.createDataFrame([(i, "x" if i < 12 else "y") for i in range(24)], "individual long, cohort string")
    found = job.run_cohorts(profile, None, cohorts, [2, 3], 6, mut_type="raw", max_iter=20)
    rows = found.collect()
    assert len(rows) == 48 and {(r.cohort, r.k) for r in rows} == {(c, k) for c in "xy" for k in (2, 3)} and all((r.individual < 12) == (r.cohort == "x") for r in rows)
    members = spark.createDataFrame([(i, "sibling" if i % 2 else "proband", "male", float(i), float(i % 2)) for i in range(24)], "individual long, role string, sex string, iq double, srs double")
    tests = {(r.k, r.measure): r for r in job.cohort_tests(found, members, "x", "y", ["iq", "srs"]).collect()}
    assert set(tests) == {(k, m) for k in (2, 3) for m in ("sibling", "female", "iq", "srs")}
    assert tests[2, "srs"].p1 < 0.05 and tests[2, "srs"].p2 < 0.05 and tests[2, "srs"].levels == [2, 2] and tests[2, "iq"].levels[0] == 0
