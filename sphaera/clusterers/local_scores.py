"""Feature scores of the rows of one ball, in NumPy; the same definitions as ``operators.features``."""

from __future__ import annotations

import numpy as np

from sphaera.clusterers.kernels import pairwise
from sphaera.operators.features import shape_entropy
from sphaera.operators.windows import EPS


def discernibility(x: np.ndarray) -> np.ndarray:
    """Sample deviation times 1 less the mean absolute correlation with the other features."""
    if len(x) < 2:
        return np.zeros(x.shape[1])
    std = x.std(0, ddof=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.abs(np.corrcoef(x, rowvar=False))).reshape(x.shape[1], x.shape[1])
    np.fill_diagonal(r, 0.0)
    return std * (1 - r.sum(1) / max(x.shape[1] - 1, 1))


def spreads(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaps to the means of the k values before and after, in each column's order."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    v = np.take_along_axis(x, order, 0)
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(v, 0)])
    i = np.arange(n)
    lo, hi = np.maximum(i - k, 0), np.minimum(i + k + 1, n)
    before = v - (total[i] - total[lo]) / np.maximum(i - lo, 1)[:, None]
    after = (total[hi] - total[i + 1]) / np.maximum(hi - i - 1, 1)[:, None] - v
    if n > 1:
        before[0], after[-1] = after[0], before[-1]
    out = []
    for side in (before, after):
        back = np.empty_like(side)
        np.put_along_axis(back, order, np.maximum(side, EPS), 0)
        out.append(back)
    return out[0], out[1]


def parts(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    left, right = spreads(x, k)
    s = np.maximum(np.maximum(left.max(0), right.max(0)), EPS)
    mu = np.clip(1 - np.abs(x - x.mean(0)) / (x.std(0) + EPS), -1, 1)
    return np.exp(left / s), np.exp(right / s), mu


def _entropy(log_weight: np.ndarray) -> np.ndarray:
    z = log_weight - log_weight.max(0)
    e = np.exp(z)
    s = e.sum(0)
    return np.log(s) - (e * z).sum(0) / s


def intensities(x: np.ndarray, k: int) -> np.ndarray:
    left, right, mu = parts(x, k)
    grid, table = shape_entropy()
    e = np.interp(mu, grid, table) * (np.exp(-1 / left) + np.exp(-1 / right)) / (2 * np.interp(0.0, grid, table))
    return np.log1p(-np.clip(e, EPS, 1 - EPS))


def entropy_scores(x: np.ndarray, k: int) -> np.ndarray:
    """Entropy of all features less that without each; constant columns score -inf."""
    t = intensities(x, k)
    total = t.sum(1)
    score = _entropy(total[:, None]) - _entropy(total[:, None] - t)
    return np.where(np.ptp(x, axis=0) > 0, score, -np.inf)


def edges(x: np.ndarray, k: int, mutual: bool) -> tuple[np.ndarray, np.ndarray]:
    d = pairwise(x, x)
    np.fill_diagonal(d, np.inf)
    near = np.zeros(d.shape, bool)
    np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)], True, 1)
    near = near & near.T if mutual else near | near.T
    i, j = np.nonzero(near)
    return i[i < j], j[i < j]


def similarity(x: np.ndarray, k: int, share: float, mutual: bool) -> np.ndarray:
    """(edges, features): how alike the ends of each edge are."""
    i, j = edges(x, k, mutual)
    left, right, mu = parts(x, k)
    grid, table = shape_entropy(-2.0, 2.0, 1025)
    gap = lambda v: np.exp(-np.abs(v[i] - v[j]))
    shape = np.interp(mu[i] - mu[j], grid, table) / (2 * np.interp(0.0, grid, table))
    return share * gap(x) + (1 - share) * (gap(left) + gap(right)) * shape


def graph_scores(s: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(s.shape[1])
    g = s.mean(1, keepdims=True)
    return ((s - g) ** 2).sum(0) / (max(s.shape[1] - 1, 1) ** 2 * ((g * g).sum() + EPS))


def rank_norm(score: np.ndarray) -> np.ndarray:
    """1 for the greatest down to 0; what is not finite gets 0."""
    n = len(score)
    out = np.empty(n)
    out[np.lexsort((np.arange(n), -np.where(np.isfinite(score), score, -np.inf)))] = 1 - np.arange(n) / max(n - 1, 1)
    return np.where(np.isfinite(score), out, 0.0)


def label_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray, bins: int = 5) -> np.ndarray:
    """Weighted information of quantile-binned features about the labels."""
    out = np.zeros(x.shape[1])
    total = weight.sum()
    if total <= 0:
        return out
    _, code = np.unique(y, return_inverse=True)
    for f in range(x.shape[1]):
        cell = np.searchsorted(np.quantile(x[:, f], np.arange(1, bins) / bins), x[:, f])
        joint = np.zeros((bins, code.max() + 1))
        np.add.at(joint, (cell, code), weight / total)
        a, b = joint.sum(1, keepdims=True), joint.sum(0, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[f] = np.nansum(np.where(joint > 0, joint * np.log(joint / (a * b)), 0.0))
    return out


def order_by(score: np.ndarray) -> np.ndarray:
    return np.lexsort((np.arange(len(score)), -score))


def redundancy_order(x: np.ndarray, score: np.ndarray, want: int, penalty: float) -> np.ndarray:
    """Greedy order by score less ``penalty`` times the greatest absolute correlation with what is chosen."""
    pool = order_by(score)[: max(64, 4 * want)]
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.nan_to_num(np.abs(np.corrcoef(x[:, pool], rowvar=False))).reshape(len(pool), len(pool))
    chosen: list[int] = []
    worst = np.zeros(len(pool))
    for _ in range(min(want, len(pool))):
        value = score[pool] - penalty * worst
        value[chosen] = -np.inf
        best = int(np.argmax(value))
        chosen.append(best)
        worst = np.maximum(worst, r[best])
    return pool[chosen]


def stable_prefix(x: np.ndarray, k: int, order: np.ndarray, s: np.ndarray, limit: float) -> int:
    """Fewest leading features whose entropy and mean graph lie within ``limit`` of those of all."""
    t = np.cumsum(intensities(x, k)[:, order], axis=1)
    curve = _entropy(t)
    by_entropy = np.abs(curve - curve[-1]) / max(abs(curve[-1]), EPS)
    if len(s):
        mean = np.cumsum(s[:, order], axis=1) / np.arange(1, len(order) + 1)
        by_graph = np.sqrt(((mean - mean[:, -1:]) ** 2).sum(0)) / max(np.sqrt((mean[:, -1] ** 2).sum()), EPS)
    else:
        by_graph = np.zeros(len(order))
    good = np.nonzero((by_entropy <= limit) & (by_graph <= limit))[0]
    return int(good[0]) + 1 if len(good) else len(order)
