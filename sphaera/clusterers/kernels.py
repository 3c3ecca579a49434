"""NumPy kernels that work on the rows of one ball or on a ball graph."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

from sphaera.operators import distance

#: Distances that are held at once where a table of all pairs would be too large.
BLOCK = 1 << 22
#: Groups of points on which a graph's inverse is held.
GROUPS = 1_500

Split = Callable[[np.ndarray], "np.ndarray | None"]


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows; differences are taken for narrow data, products for wide data."""
    if a.shape[1] <= 4:
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    mid = a.mean(0)
    p, q = a - mid, b - mid
    d2 = (p * p).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * p @ q.T
    return np.sqrt(np.maximum(d2, 0.0))


def radii(x: np.ndarray) -> np.ndarray:
    """Distances of the rows from their mean."""
    return np.sqrt(((x - x.mean(0)) ** 2).sum(1))


def farthest_pair(x: np.ndarray) -> tuple[int, int]:
    """Indices i < j of the most distant rows; the first such pair in row order."""
    best, pair = -1.0, (0, 0)
    step = max(1, (1 << 22) // len(x))
    for lo in range(0, len(x), step):
        d = pairwise(x[lo : lo + step], x)
        at = int(d.argmax())
        if d.flat[at] > best + 1e-12:
            best, pair = float(d.flat[at]), (lo + at // len(x), at % len(x))
    return min(pair), max(pair)


def by_farthest(x: np.ndarray, ties_first: bool) -> np.ndarray | None:
    """Which rows go left: those nearer to the first end of the farthest pair; None if all rows are equal."""
    if len(x) < 2:
        return None
    i, j = farthest_pair(x)
    if not ties_first:
        i, j = j, i
    di, dj = np.sqrt(((x - x[i]) ** 2).sum(1)), np.sqrt(((x - x[j]) ** 2).sum(1))
    if di[j] == 0:
        return None
    left = di <= dj if ties_first else di < dj
    left[i], left[j] = True, False
    return left


def by_first_end(x: np.ndarray) -> np.ndarray | None:
    """Which rows go left: those strictly nearer to the first end of the farthest pair; None if all rows are equal."""
    right = by_farthest(x[::-1], False) if len(x) > 1 else None
    return None if right is None else right[::-1]


def by_two_steps(x: np.ndarray) -> np.ndarray | None:
    """Ends: the row farthest from the mean, and the one farthest from that; ties go to the second."""
    if len(x) < 2:
        return None
    i = int(radii(x).argmax())
    di = np.sqrt(((x - x[i]) ** 2).sum(1))
    j = int(di.argmax())
    if di[j] == 0:
        return None
    left = di < np.sqrt(((x - x[j]) ** 2).sum(1))
    left[i], left[j] = True, False
    return left


def by_component(x: np.ndarray) -> np.ndarray | None:
    """Rows up to the median along the first principal axis; its largest entry is made positive."""
    c = x - x.mean(0)
    if not c.any():
        return None
    axis = np.linalg.svd(c, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    t = c @ axis
    left = t <= np.median(t)
    return left if left.any() and not left.all() else None


def kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50, starts: int = 1) -> np.ndarray:
    """Labels 0..k-1 by Lloyd's rounds from k-means++ seeds; empty clusters take the farthest row."""
    best_cost, best = np.inf, np.zeros(len(x), np.int64)
    k = min(k, len(x))
    for start in range(starts):
        rng = np.random.default_rng([seed, start])
        at = [int(rng.integers(len(x)))]
        d2 = ((x - x[at[0]]) ** 2).sum(1)
        while len(at) < k:
            total = d2.sum()
            at.append(int(rng.choice(len(x), p=d2 / total)) if total > 0 else int(rng.integers(len(x))))
            d2 = np.minimum(d2, ((x - x[at[-1]]) ** 2).sum(1))
        c, labels = x[at].copy(), None
        for _ in range(rounds):
            d = pairwise(x, c)
            new = d.argmin(1)
            for empty in np.setdiff1d(np.arange(k), new):
                new[d[np.arange(len(x)), new].argmax()] = empty
            if labels is not None and (new == labels).all():
                break
            labels = new
            c = np.stack([x[labels == i].mean(0) if (labels == i).any() else c[i] for i in range(k)])
        cost = float(((x - c[labels]) ** 2).sum())
        if cost < best_cost - 1e-12:
            best_cost, best = cost, labels
    return best


def by_two_means(x: np.ndarray, seed: int = 0, rounds: int = 50) -> np.ndarray | None:
    if len(x) < 2:
        return None
    left = kmeans(x, 2, seed, rounds) == 0
    return left if left.any() and not left.all() else None


def split_all(x: np.ndarray, split: Split) -> np.ndarray:
    """Ball numbers, left to right, of splitting until ``split`` returns None for every ball."""
    number = np.zeros(len(x), np.int64)
    stack, done = [np.arange(len(x))], 0
    while stack:
        who = stack.pop()
        left = split(x[who])
        if left is None or left.all() or not left.any():
            number[who] = done
            done += 1
        else:
            stack += [who[~left], who[left]]
    return number


def components(adjacent: np.ndarray) -> np.ndarray:
    """Component numbers 0.. in the order of their least member."""
    n = len(adjacent)
    label = np.full(n, -1)
    count = 0
    for i in range(n):
        if label[i] >= 0:
            continue
        frontier = np.zeros(n, bool)
        frontier[i] = True
        inside = frontier.copy()
        while frontier.any():
            frontier = adjacent[frontier].any(0) & ~inside
            inside |= frontier
        label[inside] = count
        count += 1
    return label


def spectral(affinity: np.ndarray, k: int, seed: int, starts: int = 10) -> np.ndarray:
    """Labels from the leading eigenvectors of the normalised graph, rows scaled to length 1, by k-means."""
    degree = affinity.sum(1)
    scale = 1 / np.sqrt(np.maximum(degree, np.finfo(float).tiny))
    _, vectors = np.linalg.eigh(scale[:, None] * affinity * scale[None, :])
    return _by_direction(vectors[:, -k:], k, seed, starts)


def _by_direction(v: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    v = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-12)[:, None]
    return kmeans(v, k, seed, starts=starts)


def spectral_rows(rows: Callable[[int, int], np.ndarray], m: int, k: int, seed: int, starts: int = 10) -> np.ndarray:
    """The same where ``rows(lo, hi)`` gives rows of the affinity, which is never held as a whole.

    Eigenvectors come from a block Krylov space that is made orthogonal in full and started again from its leading vectors,
    until the residuals of all k are below 1e-10.
    """
    step = max(1, BLOCK // m)
    blocks = [(lo, min(lo + step, m)) for lo in range(0, m, step)]
    degree = np.concatenate([rows(lo, hi).sum(1) for lo, hi in blocks])
    scale = (1 / np.sqrt(np.maximum(degree, np.finfo(float).tiny)))[:, None]
    wide = min(m, k + 6)
    basis, image = np.empty((m, 0)), np.empty((m, 0))
    fresh = np.random.default_rng(seed).normal(size=(m, wide))
    for _ in range(400):
        for _ in range(2):
            fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        scaled = scale * fresh
        moved = scale * np.concatenate([rows(lo, hi) @ scaled for lo, hi in blocks])
        basis, image = np.concatenate([basis, fresh], axis=1), np.concatenate([image, moved], axis=1)
        small = basis.T @ image
        value, inner = np.linalg.eigh((small + small.T) / 2)
        lead = inner[:, -k:]
        residual = image @ lead - (basis @ lead) * value[-k:]
        if np.sqrt((residual * residual).sum(0)).max() < 1e-10:
            return _by_direction(basis @ lead, k, seed, starts)
        fresh = (moved - basis @ (basis.T @ moved))[:, : m - basis.shape[1]]
        if basis.shape[1] >= 12 * wide:
            basis, image = basis @ inner[:, -2 * wide :], image @ inner[:, -2 * wide :]
    raise RuntimeError("eigenvectors did not settle")


def tied_groups(a: np.ndarray, b: np.ndarray, w: np.ndarray, m: int, most: int) -> np.ndarray:
    """Numbers of ``most`` groups of m points (more if ties do not suffice) along the strongest of their ties (a, b, w), given both ways.

    In rounds, groups that are each other's strongest are joined, then those join that are strongly tied to one just joined. Ties
    count by the degrees of their ends, so what hardly hangs on the rest stays by itself to the last.
    """
    group, n = np.arange(m), m
    while n > most:
        degree, other = np.bincount(a, w, n), a != b
        i, j = a[other], b[other]
        if not len(i):
            break
        s = w[other] / np.sqrt(degree[i] * degree[j])
        order = np.lexsort((np.minimum(i, j) * n + np.maximum(i, j), -s, i))
        first = order[np.diff(i[order], prepend=-1) > 0]
        best, strength, root = np.full(n, -1), np.zeros(n), np.arange(n)
        best[i[first]], strength[i[first]] = j[first], s[first]
        tied = i[first]
        pair = tied[(best[best[tied]] == tied) & (tied < best[tied])]
        pair = pair[np.argsort(-strength[pair], kind="stable")][: n - most]
        root[best[pair]] = pair
        taken = np.isin(np.arange(n), [pair, best[pair]])
        follow = tied[~taken[tied] & taken[best[tied]] & (strength[tied] >= np.median(strength[tied]))]
        follow = follow[np.argsort(-strength[follow], kind="stable")][: n - most - len(pair)]
        root[follow] = root[best[follow]]
        names, to = np.unique(root, return_inverse=True)
        group, n = to[group], len(names)
        code, at = np.unique(to[a] * n + to[b], return_inverse=True)
        a, b, w = code // n, code % n, np.bincount(at, w)
    return group


def edge_spectrum(a: np.ndarray, b: np.ndarray, w: np.ndarray, m: int, k: int, seed: int) -> np.ndarray:
    """The k leading eigenvectors of the normalised graph of m points with the entries (a, b, w), of which no table of all pairs is held.

    Points that hardly hang on the rest give hundreds of values within 1e-7 of 1, which powers of the graph do not part. So the
    residuals are refined before they widen the basis: once by the graph and, for what it leaves, by an inverse on
    groups of tied points, whose own vectors are the start. A full basis is cut back to its leading part. It ends when the
    residuals of all k are below 1e-8.
    """
    degree = np.bincount(a, w, m)
    scale = 1 / np.sqrt(np.maximum(degree, np.finfo(float).tiny))
    order = np.argsort(a, kind="stable")
    group = tied_groups(a, b, w, m, min(GROUPS, max(k, m // 8)))
    a, b, v = a[order], b[order], (w * scale[a] * scale[b])[order]
    start, g = np.searchsorted(a, np.arange(m)), int(group.max()) + 1
    share = np.sqrt(degree / np.bincount(group, degree, g)[group])

    def times(x: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(v * c[b], start) for c in np.ascontiguousarray(x.T)], axis=1)

    def refined(x: np.ndarray) -> np.ndarray:
        left = np.stack([np.bincount(group, share * c, g) for c in times(x).T], axis=1)
        return x + times(x + share[:, None] * (inverse @ left)[group])

    inverse = np.bincount(group[a] * g + group[b], -v * share[a] * share[b], g * g).reshape(g, g)
    inverse[np.arange(g), np.arange(g)] += 1 + 1e-9
    inverse = np.linalg.inv(inverse)
    wide = min(m, k + 4)
    lead = np.random.default_rng(seed).normal(size=(g, min(wide, g)))
    for _ in range(30):
        lead = np.linalg.qr(inverse @ lead)[0]
    fresh = share[:, None] * lead[group]
    cap = min(m, 6 * wide)
    basis, image, n = np.empty((m, cap)), np.empty((m, cap)), 0
    for _ in range(2_000):
        for _ in range(2):
            fresh = np.linalg.qr(fresh - basis[:, :n] @ (basis[:, :n].T @ fresh))[0]
        step = fresh.shape[1]
        basis[:, n : n + step], image[:, n : n + step] = fresh, times(fresh)
        n += step
        small = basis[:, :n].T @ image[:, :n]
        value, inner = np.linalg.eigh((small + small.T) / 2)
        lead = basis[:, :n] @ inner[:, -wide:]
        rest = image[:, :n] @ inner[:, -wide:] - lead * value[-wide:]
        residual = np.sqrt((rest * rest).sum(0))
        if n == m or residual[-k:].max() < 1e-8:
            return lead[:, -k:]
        if n + wide > cap:
            inner = inner[:, -min(n, max(wide, cap // 3)) :]
            kept = inner.shape[1]
            basis[:, :kept], image[:, :kept], n = basis[:, :n] @ inner, image[:, :n] @ inner, kept
        rough = residual >= 1e-9
        fresh = refined(rest[:, rough] / residual[rough])[:, : m - n]
    raise RuntimeError("eigenvectors did not settle")


def gap_tree(c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gap, a, b): the tree of least gaps between the surfaces of balls, grown from the first with one row of gaps at a time."""
    m, mid = len(c), c - c.mean(0)
    who, x, radius = np.arange(1, m), mid[1:], r[1:]
    squares = (x * x).sum(1)
    best, source = np.full(m - 1, np.inf), np.zeros(m - 1, np.int64)
    gap, a, b = np.empty(m - 1), np.empty(m - 1, np.int64), np.empty(m - 1, np.int64)
    live, at = m - 1, 0
    for n in range(m - 1):
        far = x @ (-2 * mid[at])
        far += squares
        far += float(mid[at] @ mid[at])
        np.sqrt(np.maximum(far, 0.0, out=far), out=far)
        far -= radius
        far -= r[at]
        nearer = np.nonzero(far < best)[0]
        nearer = nearer[who[nearer] >= 0]
        best[nearer], source[nearer] = far[nearer], at
        i = int(best.argmin())
        gap[n], a[n], b[n] = best[i], source[i], who[i]
        at, who[i], best[i] = int(who[i]), -1, np.inf
        live -= 1
        if live < 0.9 * len(who):
            stay = who >= 0
            who, x, radius, squares, best, source = who[stay], x[stay], radius[stay], squares[stay], best[stay], source[stay]
    return gap, a, b


def apart(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the rows i from the rows j, summed entry by entry."""
    total = np.zeros(len(i))
    for f in range(c.shape[1]):
        diff = c[i, f] - c[j, f]
        total += diff * diff
    return np.sqrt(total)


def nearest(c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k nearest other rows of each row, equal ones in their order, from blocks of distances."""
    m = len(c)
    if k < 1:
        return np.empty((m, 0), np.int64), np.empty((m, 0))
    rows, near, far = np.arange(m), np.empty((m, k), np.int64), np.empty((m, k))
    step = max(1, BLOCK // 4 // m)
    for lo in range(0, m, step):
        _, j, d, _ = distance.top(*distance.block_nearest(rows[lo : lo + step], c[lo : lo + step], rows, c, k, True), k)
        near[lo : lo + step], far[lo : lo + step] = j.reshape(-1, k), d.reshape(-1, k)
    return near, far


def nearest_earlier(c: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, row) of the nearest of the rows that come earlier in ``order``, from blocks of distances; 0 and -1 for the first."""
    delta, parent = np.zeros(len(c)), np.full(len(c), -1)
    y = c[order]
    lo = 1
    while lo < len(y):
        hi = min(len(y), lo + max(1, BLOCK // (lo + 1024)), lo + 1024)
        d = pairwise(y[lo:hi], y[:hi])
        d[np.arange(hi) >= np.arange(lo, hi)[:, None]] = np.inf
        at = d.argmin(1)
        delta[order[lo:hi]], parent[order[lo:hi]] = d[np.arange(hi - lo), at], order[at]
        lo = hi
    return delta, parent


def widest(c: np.ndarray) -> float:
    """The greatest distance of two rows, from blocks of distances."""
    step = max(1, BLOCK // max(1, len(c)))
    return max((float(pairwise(c[lo : lo + step], c).max()) for lo in range(0, len(c), step)), default=0.0)


def edge_components(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers 0.. of m points by their edges, in the order of their least member."""
    root = list(range(m))
    for i, j in zip(a.tolist(), b.tolist()):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        root[max(i, j)] = min(i, j)
    for i in range(m):
        root[i] = root[root[i]]
    return np.unique(np.array(root, np.int64), return_inverse=True)[1]


def density_peaks(density: np.ndarray, d: np.ndarray, k: int, scale_small: bool = False) -> np.ndarray:
    """Labels 0..k-1: the k balls of greatest density times distance to a denser one, others follow that one."""
    order = np.argsort(-density, kind="stable")
    m = len(order)
    delta, parent = np.zeros(m), np.full(m, -1)
    for r in range(1, m):
        i, earlier = order[r], order[:r]
        j = int(d[i, earlier].argmin())
        delta[i], parent[i] = d[i, earlier[j]], earlier[j]
    return _peaks(density, order, delta, parent, k, scale_small)


def point_peaks(density: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The same by Euclidean distances of points, of which no table of all pairs is held."""
    order = np.argsort(-density, kind="stable")
    return _peaks(density, order, *nearest_earlier(c, order), k)


def _peaks(density: np.ndarray, order: np.ndarray, delta: np.ndarray, parent: np.ndarray, k: int, scale_small: bool = False) -> np.ndarray:
    m = len(order)
    if m > 1:
        delta[order[0]] = np.where(np.isfinite(delta), delta, 0).max()
    if scale_small and m and delta.max() < 1:
        delta = delta * 10
    worth = np.where(density * delta == density * delta, density * delta, 0.0)
    label = np.full(m, -1)
    label[np.argsort(-worth, kind="stable")[:k]] = np.arange(min(k, m))
    for i in order:
        if label[i] < 0:
            label[i] = label[parent[i]] if parent[i] >= 0 else 0
    return label


def path_peaks(density: np.ndarray, edges: dict[int, dict[int, float]], k: int, scale_small: bool = False) -> np.ndarray:
    """Density peaks by shortest paths; from each ball paths are followed until the first denser one.

    A ball that reaches none is infinitely far from all of them and follows the densest.
    """
    order = np.argsort(-density, kind="stable")
    m = len(order)
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    place = rank.tolist()
    delta, parent = np.zeros(m), np.full(m, -1)
    for s in order[1:].tolist():
        best, queue, found, length = {s: 0.0}, [(0.0, s)], place[order[0]], np.inf
        while queue and queue[0][0] <= length:
            c, i = heapq.heappop(queue)
            if c > best[i]:
                continue
            if place[i] < place[s]:
                found, length = (min(found, place[i]) if length == c else place[i]), c
            for j, w in edges.get(i, {}).items():
                if c + w < best.get(j, np.inf):
                    best[j] = c + w
                    heapq.heappush(queue, (c + w, j))
        delta[s], parent[s] = length, order[found]
    return _peaks(density, order, delta, parent, k, scale_small)


def shortest_paths(edges: dict[int, dict[int, float]], m: int) -> np.ndarray:
    """All pairs by Dijkstra; unreachable pairs stay infinite."""
    out = np.full((m, m), np.inf)
    for s in range(m):
        best = {s: 0.0}
        queue = [(0.0, s)]
        while queue:
            c, i = heapq.heappop(queue)
            if c > best[i]:
                continue
            for j, w in edges.get(i, {}).items():
                if c + w < best.get(j, np.inf):
                    best[j] = c + w
                    heapq.heappush(queue, (c + w, j))
        for j, c in best.items():
            out[s, j] = c
    return out
