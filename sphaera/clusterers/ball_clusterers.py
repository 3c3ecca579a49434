"""Clusterers whose balls partition the samples: density peaks, spectral, connected and merged balls.

Each takes (sample_id, features) and gives (sample_id, label). Balls are generated by Spark (see
``operators.balls``), their statistics are aggregates, and only the ball graph, whose size is checked, is worked
on the driver. Samples of a ball get its label by a join. True labels never enter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera.clusterers import kernels as K
from sphaera.operators import balls

GENERATED = "sample_id", "features", "ball"


def _stats(members: DataFrame, limit: int | None = balls.PAIRED) -> dict[str, np.ndarray]:
    return balls.collect_balls(balls.with_density(balls.ball_stats(members)), limit)


def _count(samples: DataFrame) -> int:
    return samples.count()


def pojg_balls(samples: DataFrame, gamma: float = 0.0, delta: float = 0.5) -> DataFrame:
    """Balls of greatest total quality in a tree of farthest-pair splits.

    A node is split while it has more than max(delta sqrt(n), n^1/4) rows. Its quality is the number of rows within
    the mean radius times exp(-gamma mean radius); two children replace a node only if theirs is greater in sum.
    The root, and nodes too large for a task, are always split. Balls far wider than the mean are split again.
    """
    n = _count(samples)
    bound = max(delta * math.sqrt(n), n**0.25)

    def quality(x: np.ndarray) -> float:
        r = K.radii(x)
        return float((r <= r.mean() + 1e-15).sum() * math.exp(-gamma * r.mean()))

    def kernel(x: np.ndarray) -> np.ndarray:
        def best(who: np.ndarray, top: bool) -> tuple[float, list[np.ndarray]]:
            stack, nodes = [(who, top, -1)], []
            while stack:
                part, is_top, parent = stack.pop()
                nodes.append([part, -1.0 if is_top else quality(x[part]), parent, []])
                if len(part) > bound:
                    left = K.by_farthest(x[part], True)
                    if left is not None:
                        me = len(nodes) - 1
                        stack += [(part[~left], False, me), (part[left], False, me)]
            combined: list[list[np.ndarray]] = [[node[0]] for node in nodes]
            for i in range(len(nodes) - 1, 0, -1):
                nodes[nodes[i][2]][3].append(i)
            for i in range(len(nodes) - 1, -1, -1):
                children = sorted(nodes[i][3])
                if children and sum(nodes[c][1] for c in children) > nodes[i][1]:
                    nodes[i][1] = sum(nodes[c][1] for c in children)
                    combined[i] = [b for c in children for b in combined[c]]
            return nodes[0][1], combined[0]

        number = np.zeros(len(x), np.int64)
        for b, who in enumerate(best(np.arange(len(x)), True)[1]):
            number[who] = b
        return number

    members = balls.generate(samples, kernel)
    sizes = balls.ball_stats(members).agg(F.avg("avg_radius"), F.sum("size")).first()
    wide, half = 2 * sizes[0], 0.5 * sizes[1]

    def again(x: np.ndarray) -> np.ndarray:
        return K.split_all(x, lambda y: K.by_farthest(y, True) if 2 <= len(y) <= half and K.radii(y).mean() > wide else None)

    return balls.refine(members, again)


def gb_pojg_gbdpc(samples: DataFrame, k: int, gamma: float = 0.0, delta: float = 0.5, seed: int = 0) -> DataFrame:
    """Density peaks over quality-pruned balls; labels 1..k."""
    members = pojg_balls(samples, gamma, delta)
    s = _stats(members)
    labels = K.density_peaks(s["peak_density"], K.pairwise(s["center"], s["center"]), k) + 1
    return balls.scatter(members, s["ball"], labels)


def gb_pojg_gbsc(samples: DataFrame, k: int, gamma: float = 0.0, delta: float = 0.5, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Spectral clustering of quality-pruned balls by the gap between mean radii; labels 1..k."""
    members = pojg_balls(samples, gamma, delta)
    s = _stats(members)
    gap = np.maximum(K.pairwise(s["center"], s["center"]) - s["avg_radius"][:, None] - s["avg_radius"][None, :], 0)
    similar = np.exp(-gap * gap / (2 * sigma * sigma))
    np.fill_diagonal(similar, 1.0)
    return balls.scatter(members, s["ball"], K.spectral(similar, min(k, len(similar)), seed) + 1)


def _mean_density(x: np.ndarray) -> float:
    total = K.radii(x).sum()
    return len(x) / total if total > 0 else float(len(x))


def _radius_pass(members: DataFrame, split) -> DataFrame:
    """Split balls wider than twice the greater of median and mean radius over balls of at least two rows."""
    r = balls.ball_stats(members).where("size >= 2").agg(F.median("max_radius"), F.avg("max_radius")).first()
    if r[0] is None:
        return members
    bound = 2 * max(r[0], r[1])
    return balls.refine(members, lambda x: K.split_all(x, lambda y: split(y) if len(y) > 1 and K.radii(y).max() > bound else None))


def gbsc_balls(samples: DataFrame) -> DataFrame:
    """Split balls of at least 8 rows while their children's weighted density is greater; then the wide ones."""

    def split(x: np.ndarray) -> np.ndarray | None:
        left = K.by_farthest(x, False) if len(x) >= 8 else None
        if left is None:
            return None
        a, b = x[left], x[~left]
        return left if (len(a) * _mean_density(a) + len(b) * _mean_density(b)) / len(x) > _mean_density(x) else None

    return _radius_pass(balls.generate(samples, lambda x: K.split_all(x, split)), lambda y: K.by_farthest(y, False))


def _surface_affinity(c: np.ndarray, r: np.ndarray, sigma: float, lo: int, hi: int) -> np.ndarray:
    """Rows of the affinity of ``gbsc``."""
    a = K.pairwise(c[lo:hi], c)
    a -= r[lo:hi, None]
    a -= r[None, :]
    a *= a
    a *= -1 / (2 * sigma * sigma * c.shape[1])
    np.exp(a, out=a)
    a[np.arange(hi - lo), np.arange(lo, hi)] = 0.0
    return a


def gbsc(samples: DataFrame, k: int, sigma: float = 1.0, seed: int = 0) -> DataFrame:
    """Spectral clustering of balls by the signed distance of their surfaces over sqrt(width); labels 0..k-1."""
    members = gbsc_balls(samples)
    s = _stats(members, None)
    if len(s["ball"]) > balls.PAIRED:
        rows = lambda lo, hi: _surface_affinity(s["center"], s["max_radius"], sigma, lo, hi)
        return balls.scatter(members, s["ball"], K.spectral_rows(rows, len(s["ball"]), k, seed))
    gap = (K.pairwise(s["center"], s["center"]) - s["max_radius"][:, None] - s["max_radius"][None, :]) / math.sqrt(s["center"].shape[1])
    affinity = np.exp(-gap * gap / (2 * sigma * sigma))
    np.fill_diagonal(affinity, 0.0)
    return balls.scatter(members, s["ball"], K.spectral(affinity, min(k, len(affinity)), seed))


def gb_dp(samples: DataFrame, k: int, seed: int = 8) -> DataFrame:
    """Density peaks over balls of fewer than ceil(sqrt n) rows by two-means; labels 1..k.

    The density is size / (radius^2 mean absolute deviation of coordinates).
    """
    bound = math.ceil(math.sqrt(_count(samples)))
    members = balls.generate(samples, lambda x: K.split_all(x, lambda y: K.by_two_means(y, seed) if len(y) >= bound else None))
    mid = balls.centers(members).select("ball", "center")
    spread = members.join(mid, "ball").select("ball", F.posexplode(F.zip_with("features", "center", lambda a, b: F.abs(a - b))).alias("f", "v"))
    spread = spread.groupBy("ball").agg(F.avg("v").alias("deviation"))
    s = balls.collect_balls(balls.ball_stats(members).join(spread, "ball"))
    volume = s["max_radius"] ** 2 * s["deviation"]
    density = np.divide(s["size"], volume, out=np.zeros(len(volume)), where=volume > 0)
    return balls.scatter(members, s["ball"], K.density_peaks(density, K.pairwise(s["center"], s["center"]), k, scale_small=True) + 1)


def _spread_quality(x: np.ndarray) -> float:
    if len(x) <= 2:
        return math.inf
    r = K.radii(x)
    return float(r.mean() * (1 + r.std() / (r.mean() + 1e-10)))


def egbdpm(samples: DataFrame, k: int, k_neighbors: int = 5, seed: int = 42) -> DataFrame:
    """Density peaks along a graph of arcs over balls split at the median of their first axis; labels 0..k-1."""
    n = _count(samples)
    first = math.ceil(math.sqrt(n))

    def split(x: np.ndarray) -> np.ndarray | None:
        left = K.by_component(x) if len(x) > 8 else None
        if left is None:
            return None
        a, b = x[left], x[~left]
        worth = (len(a) * _spread_quality(a) + len(b) * _spread_quality(b)) / len(x)
        return left if worth < _spread_quality(x) else None

    def kernel(x: np.ndarray) -> np.ndarray:
        start = K.kmeans(x, min(first, len(x)), seed, rounds=1)
        number, done = np.zeros(len(x), np.int64), 0
        for c in np.unique(start):
            who = np.nonzero(start == c)[0]
            inner = K.split_all(x[who], split)
            number[who] = inner + done
            done += int(inner.max()) + 1
        return number

    members = balls.generate(samples, kernel)
    q = balls.ball_stats(members).where("size > 1").agg(*[F.percentile("max_radius", p) for p in (0.25, 0.5, 0.75, 0.95)]).first()
    if q[0] is not None:
        bound = min(max(q[2] + 1.5 * (q[2] - q[0]), q[1]), q[3])
        members = balls.refine(members, lambda x: K.split_all(x, lambda y: K.by_component(y) if len(y) > 2 and K.radii(y).max() > bound else None))
    s = _stats(members, None)
    c, m = s["center"].astype(float), len(s["ball"])
    near = np.column_stack([np.arange(m), K.nearest(c, min(k_neighbors, m - 1))[0]])
    base = np.where(s["size"] <= 2, 1000.0, np.where(np.isfinite(s["quality"]), s["quality"], 1000.0))
    density = np.array([len(row) / max(base[row].sum(), 1e-300) for row in near])
    edges: dict[int, dict[int, float]] = {i: {} for i in range(m)}
    for i in range(m):
        middle, radius = _sphere(c[near[i]])
        for j in near[i][1:]:
            length = _arc(c[i], c[j], middle, radius)
            for a, b in ((i, int(j)), (int(j), i)):
                edges[a][b] = min(edges[a].get(b, math.inf), length)
    return balls.scatter(members, s["ball"], K.path_peaks(density, edges, k, scale_small=True))


def _sphere(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Least-squares sphere through points: |x|^2 = 2 x.c + e."""
    a = np.column_stack([2 * points, np.ones(len(points))])
    z = np.linalg.lstsq(a, (points * points).sum(1), rcond=None)[0]
    return z[:-1], math.sqrt(max(z[-1] + float(z[:-1] @ z[:-1]), 0.0))


def _arc(a: np.ndarray, b: np.ndarray, middle: np.ndarray, radius: float) -> float:
    u, v = a - middle, b - middle
    size = math.sqrt(float(u @ u) * float(v @ v))
    straight = math.sqrt(float(((a - b) ** 2).sum()))
    if size == 0 or radius == 0:
        return straight
    return max(radius * math.acos(max(-1.0, min(1.0, float(u @ v) / size))), straight)


SINGLE_STARTS = 4096
_SHARED: dict[str, Any] | None = None


@contextmanager
def shared_starts() -> Iterator[None]:
    """Within it, runs of growth over one table share the balls they start from, and equal runs of ``fi_gbhc`` their clusters: no seed changes either."""
    global _SHARED
    before, _SHARED = _SHARED, {}
    try:
        yield
    finally:
        _SHARED = before


def _starts(samples: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray]]:
    if _SHARED and _SHARED["samples"].sameSemantics(samples):
        return _SHARED["starts"]
    n = _count(samples)
    bound = max(1, -(-2 * n // SINGLE_STARTS)) if n > SINGLE_STARTS else 1
    members = balls.generate(samples, lambda x: K.split_all(x, lambda y: K.by_two_means(y, 1, 8) if len(y) > bound else None))
    starts = members, _stats(members)
    if _SHARED is not None:
        _SHARED.clear()
        _SHARED.update(samples=samples, starts=starts, owners={})
    return starts



def _grow(samples: DataFrame, k: int, growth, keeps_spread: bool) -> DataFrame:
    """All radii grow, balls that meet merge, until at most k are left.

    Every distinct sample starts as a ball of radius 0; beyond ``SINGLE_STARTS`` samples, balls of a few rows do,
    so growth always works on a bounded ball table. ``growth`` gives the step from all start distances and the
    current nearest distances.
    """
    members, s = _starts(samples)
    start, weight = s["center"].astype(float), s["size"].astype(float)
    spread = s["avg_radius"].astype(float)
    center, radius, owner = start, np.zeros(len(start)), np.arange(len(start))
    widest = float(K.pairwise(start, start).max()) if len(start) else 0.0
    while len(center) > k:
        d = K.pairwise(center, center)
        nearest = (d + np.where(np.eye(len(d), dtype=bool), np.inf, 0)).min(1)
        radius = radius + max(growth(widest, nearest), 1e-9 * widest)
        part = K.components(d <= radius[:, None] + radius[None, :])
        count = int(part.max()) + 1
        if count == len(center):
            continue
        alone = np.bincount(part) == 1
        kept = np.zeros(count)
        kept[part] = radius
        owner = part[owner]
        total = np.bincount(owner, weight)
        center = np.stack([np.bincount(owner, weight * start[:, f]) / total for f in range(start.shape[1])], axis=1)
        far = np.bincount(owner, weight * np.maximum(np.sqrt(((start - center[owner]) ** 2).sum(1)), spread)) / total
        radius = np.where(alone, kept, far if keeps_spread else 0.0)
    return balls.scatter(members, s["ball"], owner)


def _grow_evenly(start: np.ndarray, weight: np.ndarray, spread: np.ndarray, k: int, ratio: float) -> np.ndarray:
    """Cluster numbers of ``_grow`` with a constant step and spreads kept; only distances of merged balls are taken again.

    Every ball keeps a lower bound of its gap to the nearest one, counted from before all growth. Steps at which no gap can
    close only add to the radii; at others the balls whose bound is closed are compared. A merged ball takes the place of its first.
    """
    m = live = len(start)
    owner = np.arange(m)
    if m <= k:
        return owner
    d = np.empty((m, m))
    for lo in range(0, m, 512):
        d[lo : lo + 512] = K.pairwise(start[lo : lo + 512], start)
    widest = float(d.max())
    step, slack, grown = max(ratio * widest, 1e-9 * widest), 1e-6 * widest, 0.0
    np.fill_diagonal(d, np.inf)
    center, radius, gap = start.copy(), np.zeros(m), d.min(1)

    def gaps(rows: np.ndarray) -> np.ndarray:
        parts = [(d[rows[lo : lo + 512]] - radius).min(1) for lo in range(0, len(rows), 512)]
        return np.concatenate(parts) - radius[rows] + 2 * grown if parts else np.empty(0)

    while live > k:
        sure = int((gap.min() - 2 * grown - slack) / (2 * step)) if step > 0 else 0
        for _ in range(max(0, sure) + 1):
            radius += step
            grown += step
        near = np.nonzero(gap - 2 * grown <= slack)[0]
        i, j = np.nonzero(d[near] <= radius[near, None] + radius)
        if not len(i):
            gap[near] = gaps(near)
            continue
        part = K.edge_components(m, near[i], j)
        first = np.unique(part, return_index=True)[1]
        merged, gone = first[np.bincount(part) > 1], np.nonzero(first[part] != np.arange(m))[0]
        owner = first[part][owner]
        total = np.maximum(np.bincount(owner, weight, m), np.finfo(float).tiny)
        mean = np.stack([np.bincount(owner, weight * start[:, f], m) / total for f in range(start.shape[1])], axis=1)
        far = np.bincount(owner, weight * np.maximum(np.sqrt(((start - mean[owner]) ** 2).sum(1)), spread), m) / total
        center[merged], radius[merged] = mean[merged], far[merged]
        live -= len(gone)
        center[gone], d[gone], d[:, gone], gap[gone] = np.inf, np.inf, np.inf, np.inf
        alive = np.nonzero(np.isfinite(center[:, 0]))[0]
        for b in merged:
            d[b, alive] = np.sqrt(((center[alive] - center[b]) ** 2).sum(1))
            d[b, b] = np.inf
            d[alive, b] = d[b, alive]
            gap = np.minimum(gap, d[b] - radius[b] - radius + 2 * grown)
        again = np.union1d(merged, alive[gap[alive] - 2 * grown <= slack])
        gap[again] = gaps(again)
        if live < 0.8 * m:
            number = np.full(m, -1)
            number[alive] = np.arange(live)
            d, center, radius, gap, owner, m = d[np.ix_(alive, alive)], center[alive], radius[alive], gap[alive], number[owner], live
    return np.unique(owner, return_inverse=True)[1]


def fi_gbhc(samples: DataFrame, k: int, ratio: float = 0.02, seed: int = 0) -> DataFrame:
    """All radii grow by a share of the greatest distance; a merged ball gets its mean distance as radius."""
    members, s = _starts(samples)
    known = _SHARED["owners"] if _SHARED else {}
    if (k, ratio) not in known:
        known[k, ratio] = _grow_evenly(s["center"].astype(float), s["size"].astype(float), s["avg_radius"].astype(float), k, ratio)
    return balls.scatter(members, s["ball"], known[k, ratio])


def pb_gbhc(samples: DataFrame, k: int, percentile: float = 0.1, seed: int = 0) -> DataFrame:
    """All radii grow by half a percentile of nearest distances; a merged ball starts again from 0."""
    return _grow(samples, k, lambda widest, nearest: float(np.quantile(nearest, percentile)) / 2, False)


def gbct(samples: DataFrame, k: int, noise: float = 0.2, seed: int = 5) -> DataFrame:
    """Balls from k-means refined by inner density, merged by single-link similarity to exactly k; labels 0..k-1."""
    n = _count(samples)
    width = len(samples.first().features)

    def power(r: float) -> float:
        try:
            return math.pow(r, width)
        except OverflowError:
            return math.inf

    def ratio(x: np.ndarray, strong: bool) -> float:
        r = K.radii(x)
        inner = r.max() / 4 if strong else r.mean()
        outer, small = power(r.max()), power(inner)
        if not 0 < small < math.inf or not 0 < outer < math.inf:
            return math.nan
        return ((r <= inner).sum() / small) / (len(x) / outer)

    def density(x: np.ndarray) -> float:
        r = K.radii(x).max()
        return (len(x) / power(r) if 0 < power(r) < math.inf else math.nan) if len(x) > 2 else r

    def split(strong: bool):
        def rule(x: np.ndarray) -> np.ndarray | None:
            q = ratio(x, strong) if len(x) > 2 else math.nan
            if not (q >= 1.3 or q < 1):
                return None
            left = K.by_two_means(x, seed)
            if left is None:
                return None
            a, b = x[left], x[~left]
            if len(a) > 2 and len(b) > 2:
                return left
            single = not strong and min(len(a), len(b)) == 1
            return left if single and max(density(a), density(b)) >= density(x) else None

        return rule

    def kernel(x: np.ndarray) -> np.ndarray:
        start = K.kmeans(x, max(1, int(math.sqrt(len(x)))), seed)
        number, done = np.zeros(len(x), np.int64), 0
        for c in np.unique(start):
            who = np.nonzero(start == c)[0]
            once = split(True)(x[who])
            for part in [who] if once is None else [who[once], who[~once]]:
                inner = K.split_all(x[part], split(False))
                number[part] = inner + done
                done += int(inner.max()) + 1
        return number

    members = balls.generate(samples, kernel)
    sparse = balls.ball_stats(members).agg(F.avg(F.col("max_radius") / F.col("size")), F.avg("max_radius")).first()
    members = balls.refine(members, lambda x: K.split_all(x, lambda y: K.by_farthest(y, False) if len(y) > 1 and K.radii(y).max() > sparse[1] and K.radii(y).max() / len(y) > sparse[0] else None))
    s = _stats(members, None)
    r, size = s["max_radius"], s["size"].astype(float)
    dens = np.divide(size, r, out=np.full(len(r), np.inf), where=r > 0)
    finite = dens[np.isfinite(dens)]
    keep = (size >= 2) & (dens >= noise * (finite.mean() if len(finite) else 0.0))
    if keep.sum() < k:
        keep = np.ones(len(r), bool)
    core = np.nonzero(keep)[0]
    c = s["center"][core]
    part = _merge(_similar(c, r[core]), k) if len(core) <= balls.PAIRED else _merge_tree(*K.gap_tree(c, r[core]), k)
    label = np.empty(len(r), np.int64)
    label[core] = part
    rest = np.nonzero(~keep)[0]
    step = max(1, K.BLOCK // len(core))
    for lo in range(0, len(rest), step):
        label[rest[lo : lo + step]] = part[K.pairwise(s["center"][rest[lo : lo + step]], c).argmin(1)]
    return balls.scatter(members, s["ball"], label)


def _similar(c: np.ndarray, r: np.ndarray) -> np.ndarray:
    gap = K.pairwise(c, c) - r[:, None] - r[None, :]
    np.fill_diagonal(gap, np.inf)
    low = gap.min() if len(c) > 1 else 0.0
    similar = 1 / np.maximum(gap + (2 * abs(low) if low < 0 else 0.0), 1e-12)
    np.fill_diagonal(similar, 0.0)
    return similar


def _link(similar: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Greatest similarity between clusters."""
    m = int(part.max()) + 1
    out = np.zeros((m, m))
    np.maximum.at(out, (part[:, None], part[None, :]), similar)
    np.fill_diagonal(out, 0.0)
    return out


def _merge(similar: np.ndarray, k: int) -> np.ndarray:
    """Every cluster joins its most similar one as long as k stay; then the most similar pairs, one by one."""
    part = np.arange(len(similar))
    for _ in range(2):
        link = _link(similar, part)
        m = len(link)
        if m <= k:
            break
        graph = np.zeros((m, m), bool)
        graph[np.arange(m), link.argmax(1)] = True
        joined = K.components(graph | graph.T)
        if joined.max() + 1 < k:
            break
        part = joined[part]
    while part.max() + 1 > k:
        link = _link(similar, part)
        a, b = divmod(int(link.argmax()), len(link))
        if a == b:
            a, b = 0, 1
        part = np.where(part == max(a, b), min(a, b), part)
        part = np.unique(part, return_inverse=True)[1]
    return part


def _merge_tree(gap: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The same from the links of a tree of least gaps, which holds the least link of every set of balls to all others."""
    order = np.argsort(gap, kind="stable")
    gap, a, b = gap[order], a[order], b[order]
    part = np.arange(len(gap) + 1)
    for _ in range(2):
        m = int(part.max()) + 1
        if m <= k:
            break
        ends = np.stack([part[a], part[b]])
        open_ = np.nonzero(ends[0] != ends[1])[0]
        first = np.unique(ends[:, open_].T.ravel(), return_index=True)[1] // 2
        joined = K.edge_components(m, *ends[:, open_[first]])
        if joined.max() + 1 < k:
            break
        part = joined[part]
    left = np.nonzero(part[a] != part[b])[0][: max(0, int(part.max()) + 1 - k)]
    return K.edge_components(int(part.max()) + 1, part[a[left]], part[b[left]])[part]
