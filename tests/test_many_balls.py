"""Ball graphs of more balls than a table of all pairs is held of; every sample is a ball of its own here."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from sphaera.clusterers import anchor_clusterers as A
from sphaera.clusterers import ball_clusterers as B
from sphaera.clusterers import graph_clusterers as G
from sphaera.clusterers import kernels as K
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import distance, harness
from tests.test_clusterers import frame, labels_of


def alone(samples, *_):
    return samples.select("sample_id", "features", F.lpad(F.col("sample_id").cast("string"), 6, "0").alias("ball"))


def finds_both(spark, name: str, k: int = 2, noise=()):
    rng = np.random.default_rng(41)
    x = rng.normal(size=(6_200, 3)) + np.repeat([[0, 0, 0], [40, 0, 0]], 3_100, axis=0)
    got = labels_of(CLUSTERERS[name].run(frame(spark, x), k))
    assert len(got) == 6_200
    left, right = set(got[:3_100]) - set(noise), set(got[3_100:]) - set(noise)
    assert left and right and not left & right


@pytest.mark.parametrize("name, noise", [("dadc_nard", ()), ("hcdc_nard", (0,)), ("dbscan_nard", (-1,)), ("dpeak_nard", ())])
def test_natural_neighbours(spark, monkeypatch, name, noise):
    monkeypatch.setattr(G, "nard_balls", alone)
    finds_both(spark, name, noise=noise)


def test_gbct(spark, monkeypatch):
    monkeypatch.setattr(B.balls, "generate", alone)
    monkeypatch.setattr(B.balls, "refine", lambda members, kernel: members)
    finds_both(spark, "gbct")


def test_egbdpm(spark, monkeypatch):
    monkeypatch.setattr(B.balls, "generate", alone)
    # Before, paths between all pairs and more than 6,000 balls were refused.
    finds_both(spark, "egbdpm")


def test_gbsc(spark, monkeypatch):
    monkeypatch.setattr(B, "gbsc_balls", alone)
    finds_both(spark, "gbsc")


@pytest.mark.parametrize("seed", range(4))
def test_the_ways_of_many_balls_are_those_of_all_pairs(seed):
    rng = np.random.default_rng(seed)
    c, r, density, k = rng.normal(size=(200, 5)), rng.random(200) * 0.3, rng.random(200), 6
    assert (B._merge(B._similar(c, r), k) == B._merge_tree(*K.gap_tree(c, r), k)).all()
    assert (K.density_peaks(density, K.pairwise(c, c), k) == K.point_peaks(density, c, k)).all()
    edges: dict[int, dict[int, float]] = {i: {} for i in range(200)}
    for i, j in rng.integers(0, 200, (260, 2)).tolist():
        if i != j:
            edges[i][j] = edges[j][i] = float(rng.random())
    assert (K.density_peaks(density, K.shortest_paths(edges, 200), k, scale_small=True) == K.path_peaks(density, edges, k, scale_small=True)).all()
    rows = lambda lo, hi: B._surface_affinity(c, r, 1.0, lo, hi)
    assert (K.spectral(rows(0, 200), k, seed) == K.spectral_rows(rows, 200, k, seed)).all()


@pytest.mark.parametrize("seed", range(2))
def test_leading_vectors_of_entries_are_those_of_the_table(seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((300, 300)) < 0.05, rng.random((300, 300)), 0.0)
    w += w.T + np.diag(1 + rng.random(300))
    a, b = np.nonzero(w)
    scale = 1 / np.sqrt(w.sum(1))
    whole = np.linalg.eigh(scale[:, None] * w * scale)[1][:, -4:]
    got = K.edge_spectrum(a, b, w[a, b], 300, 4, seed)
    assert np.allclose(got @ got.T, whole @ whole.T, atol=1e-6)


def test_leading_vectors_settle_where_points_hardly_hang_on_the_rest():
    rng = np.random.default_rng(0)
    m, i = 900, np.arange(700)
    a, b = np.concatenate([i, i, np.arange(700, m)]), np.concatenate([(i + 1) % 700, (i + 7) % 700, rng.integers(0, 700, 200)])
    w = np.concatenate([rng.random(1400) + 0.5, 10.0 ** rng.uniform(-9, -4, 200), np.ones(m)])
    a, b, w = np.concatenate([a, b, np.arange(m)]), np.concatenate([b, a, np.arange(m)]), np.concatenate([w[:1600], w])
    table = np.zeros((m, m))
    np.add.at(table, (a, b), w)
    scale = 1 / np.sqrt(table.sum(1))
    table *= scale[:, None] * scale
    # Before: "eigenvectors did not settle", as 200 values are within 1e-4 of 1.
    got = K.edge_spectrum(a, b, w, m, 5, 1)
    value = (got * (table @ got)).sum(0)
    assert np.sqrt(((table @ got - got * value) ** 2).sum(0)).max() < 1e-8
    assert np.allclose(got.T @ got, np.eye(5), atol=1e-9) and np.allclose(np.sort(value), np.linalg.eigvalsh(table)[-5:], atol=1e-10)


def test_transfer_cut_takes_any_number_of_anchors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2)) + np.repeat([[0, 0], [30, 0], [0, 30]], 200, axis=0)
    samples = frame(spark, x)
    graph = distance.anchor_graph(samples, samples.where("sample_id % 3 = 0"), 5).localCheckpoint()
    tables = labels_of(A.transfer_cut(graph, 3, 1))
    monkeypatch.setattr(A, "MAX_ANCHORS", 100)
    # Before, 200 anchors were refused here, and groups of anchors could be more than the bound too.
    entries = labels_of(A.transfer_cut(graph, 3, 1))
    assert [len(set(entries[i : i + 200])) for i in (0, 200, 400)] == [1, 1, 1] and len(set(entries)) == 3
    assert len(set(zip(tables, entries))) == 3


@pytest.mark.parametrize("seed, ratio", [(0, 0.0005), (1, 0.003), (2, 0.02), (3, 0.05)])
def test_even_growth_is_growth_with_a_constant_step(monkeypatch, seed, ratio):
    rng = np.random.default_rng(seed)
    start = np.concatenate([rng.normal(size=(150, 5)), rng.normal(size=(80, 5)) * 0.3 + 4])
    s = {"ball": np.arange(230), "center": start, "size": rng.integers(1, 6, 230), "avg_radius": rng.random(230) * 0.1}
    monkeypatch.setattr(B, "_starts", lambda samples: (None, s))
    monkeypatch.setattr(B.balls, "scatter", lambda members, names, labels: labels)
    for k in (2, 7, 40):
        assert (B._grow(None, k, lambda widest, nearest: ratio * widest, True) == B.fi_gbhc(None, k, ratio)).all()


def test_a_grid_cuts_the_balls_of_growth_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    samples = frame(spark, rng.normal(size=(60, 2)) + np.repeat([[0, 0], [9, 0]], 30, axis=0)).withColumn("y", F.expr("cast(sample_id < 30 as int)")).localCheckpoint()
    cut, grown, generate, grow = [], [], B.balls.generate, B._grow_evenly
    monkeypatch.setattr(B.balls, "generate", lambda *a: cut.append(1) or generate(*a))
    monkeypatch.setattr(B, "_grow_evenly", lambda *a: grown.append(1) or grow(*a))
    runs = harness.run_grid(samples, 2, harness.plan_runs(spark, "fi_gbhc", "two", harness.grid({"ratio": [0.01, 0.02]}), [1, 2]), str(tmp_path / "runs"))
    assert runs.where("status = 'success' and acc = 1").count() == 4
    # Before, each of the four runs cut the balls anew.
    assert len(cut) == 1 and len(grown) == 2


def test_steps_to_wide_neighbours_are_held_in_parts(monkeypatch):
    c = np.random.default_rng(3).normal(size=(400, 3))
    whole = list(zip(*(np.concatenate(p).tolist() for p in zip(*G.Natural(c).wide()))))
    monkeypatch.setattr(G.Natural, "STEPS", 1_000, raising=False)
    z, held, step = G.Natural(c), [], G.Natural._step
    monkeypatch.setattr(G.Natural, "_step", lambda *a: held.append(step(*a)) or held[-1])
    assert list(zip(*(np.concatenate(p).tolist() for p in zip(*z.wide())))) == whole
    # Before, the steps of 64 points were held at once, however many their neighbours have.
    assert max(len(i) for i, _ in held) <= 1_000 + np.diff(z.start).max()


def test_neighbours_by_level_are_not_held_as_dictionaries():
    levels = G.Levels(np.random.default_rng(4).normal(size=(3_000, 8)))
    tracemalloc.start()
    near, natural = G._mutual_levels(levels)
    # Before, 12.1 MB of dictionaries and sets stayed.
    assert tracemalloc.get_traced_memory()[0] < 2_000_000
    tracemalloc.stop()
    assert near[7][7] == 0.0 and all(7 in natural[j] and near[7][j] == near[j][7] for j in natural[7])
