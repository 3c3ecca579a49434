"""Clusterers against plain readings of their definitions, sample by sample, on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sphaera.clusterers import ball_clusterers as B
from sphaera.clusterers import graph_clusterers as G
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import balls


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "sample_id long, features array<double>")


def table(seed: int, n: int = 120, d: int = 2) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 10, (4, d))
    return np.concatenate([rng.normal(c, s, (n // 4, d)) for c, s in zip(centres, (0.4, 0.7, 0.5, 1.0))] + [rng.uniform(-1, 11, (n - 4 * (n // 4) + 6, d))])


def same_partition(a, b) -> bool:
    pairs = set(zip(a.tolist(), b.tolist()))
    return len(pairs) == len(set(a.tolist())) == len(set(b.tolist()))


def labels_of(df) -> np.ndarray:
    p = df.toPandas().sort_values("sample_id")
    assert p.sample_id.is_unique
    return p.label.to_numpy()


def dist(a, b):
    return np.linalg.norm(a[:, None, :] - b[None, :, :], axis=2)


def joined(touch: np.ndarray) -> np.ndarray:
    """Component numbers by repeated spreading."""
    label = np.arange(len(touch))
    while True:
        new = np.array([label[touch[i] | (np.arange(len(touch)) == i)].min() for i in range(len(touch))])
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


@pytest.mark.parametrize("seed,ratio,one_task", [(1, 0.5, 10_000), (2, 0.8, 10_000), (3, 0.3, 10_000), (1, 0.5, 0), (3, 0.3, 0)])
def test_gb_dbscan(spark, seed, ratio, one_task, monkeypatch):
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    x = table(seed, 180)
    k = max(2, int(math.ceil(math.sqrt(len(x))) * 0.3))
    near = np.argsort(dist(x, x), axis=1, kind="stable")[:, :k]
    visited, cover = set(), []
    for i in range(len(x)):
        if i not in visited:
            cover.append(near[i].tolist())
            visited |= set(cover[-1])
    c = np.array([x[b].mean(0) for b in cover])
    r = np.array([np.linalg.norm(x[b] - m, axis=1).max() for b, m in zip(cover, c)])
    bar = sorted(r)[int(len(r) * ratio) - 1]
    core = [i for i in range(len(r)) if r[i] <= bar]
    part = joined(dist(c[core], c[core]) <= r[core][:, None] + r[core][None, :])
    label = np.full(len(x), -1)
    for p, b in zip(part, core):
        label[cover[b]] = p
    for b in range(len(cover)):
        if b not in core:
            known, fresh = [i for i in cover[b] if label[i] >= 0], [i for i in cover[b] if label[i] < 0]
            if known:
                label[fresh] = [label[known[int(np.linalg.norm(x[known] - x[i], axis=1).argmin())]] for i in fresh]
            else:
                label[fresh] = part[int(np.linalg.norm(c[core] - c[b], axis=1).argmin())]
    got = labels_of(CLUSTERERS["gb_dbscan"].run(frame(spark, x), 2, ratio=ratio))
    assert same_partition(got, label)


def grown(x, k, step, spread):
    """Single samples as balls; all radii grow by ``step`` and balls that meet are merged until at most k are left."""
    members = [[i] for i in range(len(x))]
    r = np.zeros(len(x))
    while len(members) > k:
        c = np.array([x[m].mean(0) for m in members])
        r = r + step(c)
        part = joined(dist(c, c) <= r[:, None] + r[None, :])
        merged, radius = [], []
        for p in range(part.max() + 1):
            who = np.nonzero(part == p)[0]
            merged.append([i for w in who for i in members[w]])
            wide = np.linalg.norm(x[merged[-1]] - x[merged[-1]].mean(0), axis=1).mean() if spread else 0.0
            radius.append(r[who[0]] if len(who) == 1 else wide)
        members, r = merged, np.array(radius)
    label = np.empty(len(x), int)
    for n, m in enumerate(members):
        label[m] = n
    return label


@pytest.mark.parametrize("seed,k,ratio", [(4, 4, 0.02), (5, 3, 0.005), (6, 6, 0.05)])
def test_fi_gbhc(spark, seed, k, ratio):
    x = table(seed, 80)
    widest = dist(x, x).max()
    assert same_partition(labels_of(CLUSTERERS["fi_gbhc"].run(frame(spark, x), k, ratio=ratio)), grown(x, k, lambda c: ratio * widest, True))


@pytest.mark.parametrize("seed,k,share", [(7, 4, 0.1), (8, 3, 0.25), (9, 8, 0.05)])
def test_pb_gbhc(spark, seed, k, share):
    x = table(seed, 80)

    def step(c):
        d = dist(c, c)
        np.fill_diagonal(d, np.inf)
        return np.percentile(d.min(1), 100 * share) / 2

    assert same_partition(labels_of(CLUSTERERS["pb_gbhc"].run(frame(spark, x), k, percentile=share)), grown(x, k, step, False))


def halves(x: np.ndarray, who: list[int]) -> tuple[list[int], list[int]]:
    """Those nearer to the first end of the farthest pair, and the rest."""
    d = dist(x[who], x[who])
    i, j = sorted(np.unravel_index(int(d.argmax()), d.shape))
    return [w for w, a, b in zip(who, d[:, i], d[:, j]) if a < b], [w for w, a, b in zip(who, d[:, i], d[:, j]) if a >= b]


@pytest.mark.parametrize("seed,scale", [(10, 2.0), (11, 1.5), (12, 3.0)])
def test_sagbc(spark, seed, scale):
    x = table(seed, 160)
    todo, cut = [list(range(len(x)))], []
    while todo:
        b = todo.pop(0)
        if len(b) <= 8:
            cut.append(b)
        else:
            todo = [*halves(x, b), *todo]
    a = np.array([x[b].mean(0) for b in cut])
    d = dist(x, a)
    near = np.argsort(d, axis=1, kind="stable")[:, :5]
    nd = np.take_along_axis(d, near, 1)
    w = np.exp(-(nd**2) / (2 * nd.mean() ** 2))
    holds = [{int(i) for i in np.nonzero((near == m).any(1))[0]} for m in range(len(a))]
    radius = []
    for m in range(len(a)):
        rows, columns = np.nonzero(near == m)
        radius.append(float((nd[rows, columns] * w[rows, columns]).sum() / w[rows, columns].sum()) if len(rows) else 0.0)
    touch = np.zeros((len(a), len(a)), bool)
    for p in range(len(a)):
        for q in range(p + 1, len(a)):
            if np.linalg.norm(a[p] - a[q]) <= scale * radius[p] and holds[p] & holds[q]:
                touch[p, q] = touch[q, p] = True
    part = joined(touch)
    want = np.full(len(x), -1)
    for i in range(len(x)):
        tied = [(w[i, c], -c, int(part[m])) for c, m in enumerate(near[i]) if touch[m].any()]
        if tied:
            want[i] = max(tied)[2]
    got = labels_of(CLUSTERERS["sagbc"].run(frame(spark, x), 2, sample_size=len(x), scale=scale))
    assert ((got == -1) == (want == -1)).all() and same_partition(got, want)


def peaks(density, d, k, small):
    """Labels of density peaks, read off the definition."""
    order = sorted(range(len(density)), key=lambda i: -density[i])
    delta, parent = {}, {}
    for r, i in enumerate(order[1:], 1):
        parent[i] = min(order[:r], key=lambda j: d[i, j])
        delta[i] = d[i, parent[i]]
    delta[order[0]] = max(delta.values())
    factor = 10.0 if small and max(delta.values()) < 1 else 1.0
    worth = sorted(range(len(density)), key=lambda i: -density[i] * delta[i] * factor)
    label = {i: n for n, i in enumerate(worth[:k])}
    for i in order:
        if i not in label:
            label[i] = label[parent[i]]
    return np.array([label[i] for i in range(len(density))])


def groups(members) -> list[list[int]]:
    p = members.select("sample_id", "ball").toPandas().sort_values("sample_id")
    return [g.sample_id.tolist() for _, g in p.groupby("ball")]


def scattered(n: int, cut: list[list[int]], labels: np.ndarray) -> np.ndarray:
    out = np.empty(n, int)
    for b, v in zip(cut, labels):
        out[b] = v
    return out


@pytest.mark.parametrize("seed,k", [(13, 3), (14, 5)])
def test_gb_dp_labels_of_its_balls(spark, seed, k, monkeypatch):
    x = table(seed, 200)
    kept = {}
    real = balls.generate
    monkeypatch.setattr(balls, "generate", lambda *a, **kw: kept.setdefault("members", real(*a, **kw)))
    got = labels_of(CLUSTERERS["gb_dp"].run(frame(spark, x), k))
    cut = groups(kept["members"])
    assert all(len(b) < math.ceil(math.sqrt(len(x))) for b in cut)
    c = np.array([x[b].mean(0) for b in cut])
    r = np.array([np.linalg.norm(x[b] - m, axis=1).max() for b, m in zip(cut, c)])
    dev = np.array([np.abs(x[b] - m).mean() for b, m in zip(cut, c)])
    density = np.array([len(b) / (p * p * q) if p > 0 else 0.0 for b, p, q in zip(cut, r, dev)])
    assert same_partition(got, scattered(len(x), cut, peaks(density, dist(c, c), k, True)))


@pytest.mark.parametrize("seed", [15, 16])
def test_gbsc_balls(spark, seed):
    x = table(seed, 140)

    def density(b):
        total = np.linalg.norm(x[b] - x[b].mean(0), axis=1).sum()
        return len(b) / total if total > 0 else float(len(b))

    todo, cut = [list(range(len(x)))], []
    while todo:
        b = todo.pop()
        parts = halves(x, b) if len(b) >= 8 else None
        if parts and all(parts) and sum(len(p) * density(p) for p in parts) / len(b) > density(b):
            todo += parts
        else:
            cut.append(b)
    far = lambda b: np.linalg.norm(x[b] - x[b].mean(0), axis=1).max()
    wide = [far(b) for b in cut if len(b) >= 2]
    bound = 2 * max(np.median(wide), np.mean(wide))
    todo, done = cut, []
    while todo:
        b = todo.pop()
        if len(b) > 1 and far(b) > bound:
            todo += halves(x, b)
        else:
            done.append(frozenset(b))
    assert set(map(frozenset, groups(B.gbsc_balls(frame(spark, x))))) == set(done)


def natural(c: np.ndarray):
    """Natural neighbours, groups, wide neighbours and densities of ball centres, read off their definitions."""
    m = len(c)
    d = dist(c, c)
    order = [[j for j in sorted(range(m), key=lambda j: (d[i, j], j)) if j != i] for i in range(m)]
    near, back, lonely = [set() for _ in range(m)], [set() for _ in range(m)], 0
    for level in range(m - 1):
        for i in range(m):
            near[i].add(order[i][level])
            back[order[i][level]].add(i)
        now = sum(1 for b in back if not b)
        if now == lonely:
            break
        lonely = now
    both = [a & b for a, b in zip(near, back)]
    sets, again = [{i} | both[i] for i in range(m)], True
    while again:
        again, out = False, []
        for s in sets:
            home = next((o for o in out if len(o & s) > 1), None)
            if home is None:
                out.append(set(s))
            else:
                home |= s
                again = True
        sets = out
    wide = both
    for _ in range(2):
        wide = [s.union(*[both[j] for j in s]) if s else s for s in wide]
    wide = [s - {i} for i, s in enumerate(wide)]
    density = np.zeros(m)
    for g in sets:
        inner = {i: [j for j in wide[i] if j in g] for i in g}
        base = {i: (1 / np.mean([d[i, j] for j in n]) if n else 1e-7) for i, n in inner.items()}
        full = {i: base[i] + sum(base[j] / d[i, j] for j in inner[i]) for i in g}
        for i in g:
            density[i] = max(density[i], full[i] / max(full.values()))
    return d, sets, wide, density


@pytest.mark.parametrize("seed", [17, 18])
def test_natural_neighbour_clusterers(spark, seed):
    x = table(seed, 150)
    df = frame(spark, x)
    cut = groups(G.nard_balls(df))
    d, sets, wide, density = natural(np.array([x[b].mean(0) for b in cut]))
    assert same_partition(labels_of(CLUSTERERS["dpeak_nard"].run(df, 2)), scattered(len(x), cut, peaks(density, d, len(sets), False)))
    top = [i for i in range(len(cut)) if density[i] >= 1]
    own = {i: n for n, i in enumerate(top)}
    order = sorted(range(len(cut)), key=lambda i: -density[i])
    for r, i in enumerate(order):
        if i not in own:
            own[i] = own[min(order[:r], key=lambda j: d[i, j])]
    assert same_partition(labels_of(CLUSTERERS["dadc_nard"].run(df, 2)), scattered(len(x), cut, np.array([own[i] for i in range(len(cut))])))
    core = density >= 0.25 * density.mean()
    label = np.full(len(cut), -1)
    count = 0
    for i in range(len(cut)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = count
            while todo:
                for j in sorted(wide[todo.pop()]):
                    if label[j] < 0:
                        label[j] = count
                        todo += [j] if core[j] else []
            count += 1
    got, want = labels_of(CLUSTERERS["dbscan_nard"].run(df, 2)), scattered(len(x), cut, label)
    assert ((got == -1) == (want == -1)).all()
    assert len(set(got)) == len(set(want)) and (got == want).mean() > 0.9 or same_partition(got, want)


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_covers_are_those_of_one_after_the_other(spark, one_task, monkeypatch):
    monkeypatch.setattr(G, "ONE_TASK", one_task)
    rng = np.random.default_rng(19)
    near = [(i, int(j)) for i in range(300) for j in rng.choice(300, 6, replace=False) if i != j]
    df = spark.createDataFrame(near, "a long, b long")
    taken, centres = set(), []
    for i in range(300):
        if i not in taken:
            centres.append(i)
            taken |= {j for a, j in near if a == i}
    got = sorted(r.sample_id for r in G.greedy_centres(spark.range(300).withColumnRenamed("id", "sample_id"), df).collect())
    assert got == centres
