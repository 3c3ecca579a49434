from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sphaera.clusterers import kernels as K
from sphaera.clusterers import local_scores as L
from sphaera.clusterers.ball_clusterers import gbsc_balls, pojg_balls
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import balls, features, metrics, scaling, windows


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "sample_id long, features array<double>")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, s, (n, 2)) for c, s, n in (([0, 0], 0.5, 70), ([8, 1], 0.7, 50), ([3, 9], 0.4, 40))])
    return scaling.min_max(frame(spark, x)), np.repeat([0, 1, 2], [70, 50, 40])


@pytest.fixture(scope="module")
def discs(spark):
    rng = np.random.default_rng(4)
    turn, far = rng.uniform(0, 2 * np.pi, 900), np.sqrt(rng.random(900))
    x = np.stack([far * np.cos(turn), far * np.sin(turn)], 1) + np.repeat([[0, 0], [6, 0], [0, 6]], 300, axis=0)
    return frame(spark, x), np.repeat([0, 1, 2], 300)


def labels_of(df):
    p = df.toPandas().sort_values("sample_id")
    assert p.sample_id.is_unique
    return p.label.to_numpy()


# The default draws a share of the samples, which of so few are not enough for anchors in each group.
MORE = {"sagbc": {"sample_size": 160}}


@pytest.mark.parametrize("name", sorted(set(CLUSTERERS) - {"gb_dbscan"}))
def test_every_clusterer_finds_three_unequal_groups(blobs, name):
    df, y = blobs
    got = labels_of(CLUSTERERS[name].run(df, 3, seed=2, **MORE.get(name, {})))
    assert len(got) == len(y)
    assert metrics.matched_metrics(pd.crosstab(y, got).to_numpy())["acc"] >= 0.9
    if CLUSTERERS[name].counts == "given":
        assert len(set(got)) == 3


def test_covers_find_three_discs(discs):
    # Covers of int(0.3 sqrt n) samples need evenly dense groups to meet.
    df, y = discs
    got = labels_of(CLUSTERERS["gb_dbscan"].run(df, 3, ratio=1.0))
    assert len(got) == 900 and metrics.matched_metrics(pd.crosstab(y, got).to_numpy())["acc"] >= 0.9


def test_far_apart_clumps_of_unequal_size_are_two_clusters(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.uniform(-1, 1, (14, 2)), rng.uniform(-1, 1, (9, 2)) + [30, -20]])
    got = labels_of(CLUSTERERS["gb_pojg_gbdpc"].run(frame(spark, x), 2, gamma=0.1, delta=0.5))
    assert len(set(got[:14])) == 1 and len(set(got[14:])) == 1 and got[0] != got[20]
    members = pojg_balls(frame(spark, x), 0.1, 0.5).toPandas()
    assert sorted(members.sample_id) == list(range(23))
    assert members.groupby("ball").sample_id.apply(lambda m: (m < 14).nunique()).max() == 1


def test_quality_balls_by_plain_recursion(spark):
    x = np.random.default_rng(5).normal(size=(40, 2))
    bound = max(0.5 * np.sqrt(40), 40**0.25)

    def value(ids):
        r = np.linalg.norm(x[ids] - x[ids].mean(0), axis=1)
        return float((r <= r.mean() + 1e-15).sum() * np.exp(-0.3 * r.mean()))

    def halves(ids):
        d = np.linalg.norm(x[ids][:, None] - x[ids][None], axis=2)
        i, j = min(divmod(int(d.argmax()), len(ids))), max(divmod(int(d.argmax()), len(ids)))
        left = (d[:, i] <= d[:, j]) & (np.arange(len(ids)) != j)
        return ids[left], ids[~left]

    def best(ids, root):
        own = -1.0 if root else value(ids)
        if len(ids) <= bound:
            return own, [ids]
        parts = [best(h, False) for h in halves(ids)]
        total = sum(v for v, _ in parts)
        return (total, parts[0][1] + parts[1][1]) if total > own else (own, [ids])

    todo = best(np.arange(40), True)[1]
    mean = np.mean([np.linalg.norm(x[b] - x[b].mean(0), axis=1).mean() for b in todo])
    done = []
    while todo:
        b = todo.pop()
        if 2 <= len(b) <= 20 and np.linalg.norm(x[b] - x[b].mean(0), axis=1).mean() > 2 * mean:
            todo += halves(b)
        else:
            done.append(frozenset(b.tolist()))
    got = pojg_balls(frame(spark, x), 0.3, 0.5).toPandas().groupby("ball").sample_id.apply(frozenset)
    assert set(got) == set(done)


def test_spectral_balls_cut_between_far_clumps(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 0.3, (25, 3)), rng.normal(0, 0.3, (16, 3)) + 6])
    got = labels_of(CLUSTERERS["gbsc"].run(frame(spark, x), 2, seed=1, sigma=1.0))
    assert len(set(got[:25])) == 1 and len(set(got[25:])) == 1 and got[0] != got[30]
    balls_ = gbsc_balls(frame(spark, x)).toPandas()
    assert sorted(balls_.sample_id) == list(range(41))
    assert balls_.groupby("ball").sample_id.apply(lambda m: (m < 25).nunique()).max() == 1


def test_anchored_balls_follow_curves(spark):
    t = np.linspace(0, np.pi, 90)
    x = np.concatenate([np.stack([np.cos(t), np.sin(t)], 1), np.stack([np.cos(t), np.sin(t) + 5], 1)])
    got = labels_of(CLUSTERERS["sagbc"].run(frame(spark, x), 2, seed=1, sample_size=180))
    assert len(got) == 180 and not set(got[:90]) & set(got[90:]) - {-1}
    assert (got == -1).mean() < 0.2


def test_equal_rows_and_constant_columns_do_not_crash(spark):
    x = [[1.0, 0.0]] * 9 + [[1.0, 5.0]] * 9
    for name in ("gb_pojg_gbdpc", "gbsc", "gb_dp", "gbct", "egbdpm", "fi_gbhc", "pb_gbhc", "dpeak_nard", "plgb_fsc", "my_v3"):
        got = labels_of(CLUSTERERS[name].run(scaling.min_max(frame(spark, x)), 2))
        assert len(got) == 18, name


def test_order_of_rows_does_not_matter(spark, blobs):
    df, _ = blobs
    a = labels_of(CLUSTERERS["gb_pojg_gbdpc"].run(df, 3))
    b = labels_of(CLUSTERERS["gb_pojg_gbdpc"].run(df.orderBy(df.sample_id.desc()).repartition(3), 3))
    assert (a == b).all()


def test_large_balls_are_split_before_the_kernel(spark, blobs):
    df, _ = blobs
    seen = balls.generate(df, lambda x: np.full(len(x), 0 if len(x) <= 16 else 1), local=16).toPandas()
    assert len(seen) == 160 and seen.ball.str.endswith("/000000").all()


def test_bad_input_is_refused(spark):
    good = frame(spark, [[0.0], [1.0], [2.0]])
    for bad in (frame(spark, [[float("nan")], [1.0]]), spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], good.schema), spark.createDataFrame([], good.schema)):
        with pytest.raises(ValueError):
            CLUSTERERS["gbsc"].run(bad, 2)
    with pytest.raises(ValueError):
        CLUSTERERS["gbsc"].run(good, 9)
    with pytest.raises(ValueError):
        CLUSTERERS["gbsc"].run(good, 2, nonsense=1)


def test_farthest_pair_and_components():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert d[K.farthest_pair(x)] == pytest.approx(d.max())
    a = np.zeros((6, 6), bool)
    a[0, 3] = a[3, 0] = a[3, 5] = a[5, 3] = True
    assert K.components(a).tolist() == [0, 1, 2, 0, 3, 0]


def test_ball_scores_equal_the_table_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(25, 4))
    long = scaling.long_form(frame(spark, x))
    spread = windows.local_spread(long, 3)
    left, right = L.spreads(x, 3)
    got = spread.toPandas()
    assert np.allclose(got["left"], left[got.sample_id, got.f]) and np.allclose(got["right"], right[got.sample_id, got.f])
    score = windows.leave_one_out(features.pdmf_intensity(spread)).toPandas().set_index("f").score
    assert np.allclose(score.sort_index(), L.entropy_scores(x, 3), atol=1e-6)
    edges = L.edges(x, 3, False)
    table = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*edges)], "a long, b long")
    imp = features.graph_importance(features.membership_similarity(table, spread, 0.5)).toPandas().set_index("f").importance
    assert np.allclose(imp.sort_index(), L.graph_scores(L.similarity(x, 3, 0.5, False)), rtol=1e-4)


def test_shape_entropy_at_zero():
    assert float(np.interp(0.0, *features.shape_entropy())) == pytest.approx(0.3702632681, abs=1e-6)


def test_many_equal_rows_are_one_ball_and_no_task(spark):
    x = np.concatenate([np.tile([[3.0, 3.0]], (60, 1)), np.random.default_rng(7).normal(size=(50, 2))])

    def kernel(part):
        assert len(part) <= 16  # equal rows beyond the bound never reach a kernel
        return np.zeros(len(part), int)

    seen = balls.generate(frame(spark, x), kernel, local=16).toPandas()
    assert len(seen) == 110 and seen[seen.sample_id < 60].ball.nunique() == 1
    assert seen.groupby("ball").size().drop(seen.ball[seen.sample_id == 0].iloc[0]).max() <= 16
