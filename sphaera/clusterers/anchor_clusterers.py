"""Clusterers over a bipartite graph of samples and anchors.

Anchors are the means of balls, far fewer than the samples. Where a table of all their pairs is held their number is checked;
``transfer_cut`` takes any number, beyond ``MAX_ANCHORS`` by the entries of their graph alone.
Samples meet anchors in Arrow batches, what flows back are aggregates over anchors (Gram matrices, sums), and
eigenvectors and coordinate ascent are taken of the anchors' matrices.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera import session
from sphaera.clusterers import kernels as K
from sphaera.clusterers import local_scores as L
from sphaera.operators import balls, distance, features, scaling, windows

MAX_ANCHORS = 4096
INIT_SAMPLE = 4096


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _first_rows(samples: DataFrame, limit: int, seed: int) -> np.ndarray:
    """A bounded sample by hash of the id, in that order."""
    rows = samples.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(limit).select("features").collect()
    return np.array([r.features for r in rows], float)


def kmeans(samples: DataFrame, k: int, seed: int, beta: float | None = None, rounds: int = 20) -> DataFrame:
    """(sample_id, label, first, second): Lloyd's rounds over all rows; with ``beta`` features are weighted.

    Centres start from a sample of ``INIT_SAMPLE`` rows: one, the farthest from it, then by squared distances. Each
    round sends the centres to the tasks and gets back sums by cluster and feature. Weights are the -1/(beta-1)th
    power of the features' dispersions. The two smallest distances of each row come along.
    """
    start = _first_rows(samples, INIT_SAMPLE, seed)
    rng = np.random.default_rng(seed)
    at = [start[0]]
    d2 = ((start - at[0]) ** 2).sum(1)
    while len(at) < min(k, len(start)):
        pick = int(d2.argmax()) if len(at) == 1 else int(rng.choice(len(start), p=d2 / d2.sum())) if d2.sum() > 0 else int(rng.integers(len(start)))
        at.append(start[pick])
        d2 = np.minimum(d2, ((start - at[-1]) ** 2).sum(1))
    centers = np.stack(at)
    weight = np.full(centers.shape[1], 1.0 / centers.shape[1]) if beta else np.ones(centers.shape[1])

    def assign(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
        return K.pairwise(x * np.sqrt(w), c * np.sqrt(w))

    def partial(c: np.ndarray, w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(c), 2 * c.shape[1] + 1))
            for batch in batches:
                x = _matrix(batch, 0)
                label = assign(x, c, w).argmin(1)
                np.add.at(sums, label, np.concatenate([np.ones((len(x), 1)), x, x * x], axis=1))
            i, f = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(f, pa.int32()), pa.array(sums[i, f])], names=["c", "f", "s"])

        return run

    before = None
    for _ in range(rounds):
        total = np.zeros((len(centers), 2 * centers.shape[1] + 1))
        for r in samples.select("features").mapInArrow(partial(centers, weight), "c int, f int, s double").groupBy("c", "f").agg(F.sum("s").alias("s")).collect():
            total[r.c, r.f] = r.s
        n, d = total[:, :1], centers.shape[1]
        centers = np.where(n > 0, total[:, 1 : d + 1] / np.maximum(n, 1), centers)
        dispersion = np.maximum((total[:, d + 1 :] - n * centers**2).sum(0), 1e-12)
        if beta:
            weight = dispersion ** (-1.0 / (beta - 1.0))
            weight /= weight.sum()
        cost = float((weight ** (beta or 1.0) * dispersion).sum())
        if before is not None and abs(before - cost) <= 1e-6 * max(cost, 1e-12):
            break
        before = cost
    c, w = centers, weight

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dist = assign(_matrix(batch, 1), c, w)
            two = np.sort(dist, axis=1)[:, : min(2, len(c))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dist.argmin(1).astype(np.int32)), pa.array(two[:, 0]), pa.array(two[:, -1])], names=["sample_id", "label", "first", "second"])

    return samples.select("sample_id", "features").mapInArrow(final, "sample_id long, label int, first double, second double")


def transfer_cut(graph: DataFrame, k: int, seed: int) -> DataFrame:
    """(sample_id, label) from the leading eigenvectors of the anchors' graph, taken back to the samples."""
    gram = distance.anchor_gram(graph).toArrow()
    ids, at = np.unique(np.concatenate([gram.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    m, a, b, weight = len(ids), at[: len(gram)], at[len(gram) :], gram.column("w").to_numpy()
    scale = 1 / np.sqrt(np.maximum(np.bincount(a, weight, m), np.finfo(float).tiny))
    if m > MAX_ANCHORS:
        vectors = K.edge_spectrum(a, b, weight, m, k, seed)
    else:
        w = np.zeros((m, m))
        w[a, b] = weight
        vectors = np.linalg.eigh(scale[:, None] * (w + w.T) / 2 * scale[None, :])[1][:, -min(k, m) :]
    place = dict(zip(ids.tolist(), range(m)))
    back = scale[:, None] * vectors

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for edges in batch.column(1).to_pylist():
                v = sum(e["w"] * back[place[e["a"]]] for e in edges) / sum(e["w"] for e in edges)
                rows.append(v / (math.sqrt(float(v @ v)) + 1e-10))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["sample_id", "features"])

    edges = graph.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(F.col("anchor_id").alias("a"), "w"))).alias("edges"))
    embedded = session.materialize(edges.mapInArrow(embed, "sample_id long, features array<double>"), "embedding")
    return kmeans(embedded, k, seed, rounds=50).select("sample_id", "label")


Scores = Callable[[DataFrame, DataFrame], np.ndarray]


def _to_array(scores: DataFrame, value: str, width: int) -> np.ndarray:
    out = np.full(width, -np.inf)
    for r in scores.select("f", value).collect():
        out[r.f] = r[value] if r[value] is not None else -np.inf
    return out


def _spread(samples: DataFrame, k: int) -> DataFrame:
    return session.materialize(windows.local_spread(scaling.long_form(samples), k), "spread")


def _global_scores(kind: str, samples: DataFrame, pseudo: DataFrame, width: int, k: int, graph_k: int, share: float) -> np.ndarray:
    """Scores of all features over all samples; every term is a Spark aggregate by feature."""
    varies = _to_array(scaling.column_ranges(samples).select("f", F.when(F.col("hi") > F.col("lo"), 0.0).alias("v")), "v", width)
    if kind == "plgb":
        n = samples.count()
        bins = min(max(10, n // 10), 100)
        long = samples.join(pseudo.select("sample_id", "label"), "sample_id").select("sample_id", "label", F.posexplode("features").alias("f", "v"))
        return _to_array(features.mutual_information(long, "label", bins), "mi", width)
    spread = _spread(samples, k)
    entropy = _to_array(windows.leave_one_out(features.pdmf_intensity(spread)), "score", width) + varies
    if kind == "v0":
        return entropy
    near = distance.knn(samples, graph_k)
    edges = distance.mutual_edges(near) if kind == "v3" else distance.union_edges(near)
    graph = _to_array(features.graph_importance(features.membership_similarity(session.materialize(edges.select("a", "b"), "edges"), spread, share)), "importance", width)
    e, g = L.rank_norm(entropy), L.rank_norm(np.where(np.isfinite(entropy), graph, -np.inf))
    if kind == "v3":
        alpha = e.std() / (e.std() + g.std() + 1e-12)
        return np.where(np.isfinite(entropy), alpha * e + (1 - alpha) * g, -np.inf)
    if kind == "v4":
        told = samples.join(pseudo, "sample_id").withColumn("confidence", (F.col("second") - F.col("first")) / F.greatest(F.col("second") + F.col("first"), F.lit(1e-12)))
        long = told.select("label", "confidence", F.posexplode("features").alias("f", "v"))
        mi = L.rank_norm(_to_array(features.weighted_information(long, "label", "confidence", 5), "mi", width))
        trust = told.agg(F.avg("confidence")).first()[0]
        return np.where(np.isfinite(entropy), (1 - trust) * (e + g) / 2 + trust * mi, -np.inf)
    return np.where(np.isfinite(entropy), (e + g) / 2, -np.inf)


def _local_choice(kind: str, x: np.ndarray, y: np.ndarray, sure: np.ndarray, p2: int, k: int, graph_k: int, share: float, limit: float, penalty: float) -> np.ndarray:
    """Which features a ball is split by."""
    want = min(p2, x.shape[1])
    if kind == "plgb" or len(x) < 3:
        return L.order_by(L.discernibility(x))[:want]
    entropy = L.entropy_scores(x, k)
    if kind == "v0":
        return L.order_by(entropy)[:want]
    s = L.similarity(x, min(graph_k, len(x) - 1), share, kind == "v3")
    e, g = L.rank_norm(entropy), L.rank_norm(L.graph_scores(s))
    if kind == "v2":
        order = L.order_by((e + g) / 2)
        return order[: max(1, L.stable_prefix(x, k, order, s, limit))]
    if kind == "v3":
        alpha = e.std() / (e.std() + g.std() + 1e-12)
        return L.redundancy_order(x, alpha * e + (1 - alpha) * g, want, penalty)
    if kind == "v4":
        trust = float(sure.mean())
        return L.order_by((1 - trust) * (e + g) / 2 + trust * L.rank_norm(L.label_scores(x, y, sure)))[:want]
    return L.order_by((e + g) / 2)[:want]


def _anchors(kind: str, chosen: DataFrame, pseudo: DataFrame, theta: float, p2: int, k: int, graph_k: int, share: float, limit: float, penalty: float, seed: int) -> DataFrame:
    """(sample_id, features): means of balls split until none has 8 rows, nor 2 rows of mixed pseudo labels.

    The pseudo label and its certainty ride behind the features. A ball's seed comes from what it holds, so balls
    can be split in any order and on any executor.
    """
    sure = (F.col("second") - F.col("first")) / F.greatest(F.col("second") + F.col("first"), F.lit(1e-12))
    told = chosen.join(pseudo.select("sample_id", "label", sure.alias("sure")), "sample_id").select("sample_id", F.concat("features", F.array(F.col("label").cast("double"), F.col("sure"))).alias("features"))

    def split(z: np.ndarray) -> np.ndarray | None:
        x, y, certain = z[:, :-2], z[:, -2], z[:, -1]
        n = len(x)
        if n < 2:
            return None
        if n < 8 and np.unique(y, return_counts=True)[1].max() / n >= theta:
            return None
        pick = _local_choice(kind, x, y, certain, p2, min(k, n - 1), graph_k, share, limit, penalty)
        part = x[:, pick]
        spread = np.ptp(part, axis=0)
        part = (part - part.min(0)) / np.where(spread > 0, spread, 1)
        left = K.by_two_means(part, zlib.crc32(np.ascontiguousarray(x).tobytes()) ^ seed, rounds=3)
        if left is None:
            left = np.arange(n) < n // 2
        return left

    members = balls.generate(told, lambda z: K.split_all(z, split))
    plain = members.select("sample_id", "ball", F.slice("features", F.lit(1), F.size("features") - 2).alias("features"))
    mid = balls.centers(plain).withColumn("sample_id", F.xxhash64("ball"))
    return session.materialize(mid.select("sample_id", F.col("center").alias("features")), "anchors")


def _pipeline(kind: str, samples: DataFrame, k: int, p1: int | None, p2: int | None, theta: float, neighbours: int, graph_neighbours: int, share: float, limit: float, penalty: float, anchors_near: int, seed: int) -> DataFrame:
    width = len(samples.first().features)
    p1 = min(p1 or max(4, width // 2), width)
    p2 = min(p2 or max(2, p1 // 2), p1)
    pseudo = session.materialize(kmeans(samples, k, seed, beta=3.0), "pseudo")
    scores = _global_scores(kind, samples, pseudo, width, neighbours, graph_neighbours, share)
    chosen = session.materialize(scaling.project_features(samples.select("sample_id", "features"), L.order_by(scores)[:p1].tolist()), "chosen")
    anchors = _anchors(kind, chosen, pseudo, theta, p2, neighbours, graph_neighbours, share, limit, penalty, seed)
    m = anchors.count()
    graph = session.materialize(distance.anchor_graph(chosen, anchors, min(anchors_near, m)), "graph")
    return transfer_cut(graph, k, seed)


def plgb_fsc(samples: DataFrame, k: int, p1: int | None = None, p2: int | None = None, theta: float = 0.75, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """Pseudo-label balls with information-based global and discernibility-based local features; labels 0..k-1."""
    return _pipeline("plgb", samples, k, p1, p2, theta, 5, 5, 0.5, 0.05, 0.0, anchors_near, seed)


def my_v0(samples: DataFrame, k: int, p1: int | None = None, p2: int | None = None, theta: float = 0.75, neighbours: int = 5, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """Features by the entropy that each one's absence costs."""
    return _pipeline("v0", samples, k, p1, p2, theta, neighbours, 5, 0.5, 0.05, 0.0, anchors_near, seed)


def my_v1(samples: DataFrame, k: int, p1: int | None = None, p2: int | None = None, theta: float = 0.75, neighbours: int = 5, graph_neighbours: int = 5, share: float = 0.5, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """Features by the mean of entropy and graph ranks."""
    return _pipeline("v1", samples, k, p1, p2, theta, neighbours, graph_neighbours, share, 0.05, 0.0, anchors_near, seed)


def my_v2(samples: DataFrame, k: int, p1: int | None = None, limit: float = 0.05, theta: float = 0.75, neighbours: int = 5, graph_neighbours: int = 5, share: float = 0.5, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """As many leading features as keep entropy and graph within ``limit``."""
    return _pipeline("v2", samples, k, p1, None, theta, neighbours, graph_neighbours, share, limit, 0.0, anchors_near, seed)


def my_v3(samples: DataFrame, k: int, p1: int | None = None, p2: int | None = None, theta: float = 0.75, neighbours: int = 5, graph_neighbours: int = 5, share: float = 0.5, penalty: float = 0.3, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """Mutual-neighbour graph, self-weighted ranks, less for features that repeat chosen ones."""
    return _pipeline("v3", samples, k, p1, p2, theta, neighbours, graph_neighbours, share, 0.05, penalty, anchors_near, seed)


def my_v4(samples: DataFrame, k: int, p1: int | None = None, p2: int | None = None, theta: float = 0.75, neighbours: int = 5, graph_neighbours: int = 5, share: float = 0.5, anchors_near: int = 5, seed: int = 1) -> DataFrame:
    """Entropy and graph ranks with the label agreement, as far as pseudo labels are certain."""
    return _pipeline("v4", samples, k, p1, p2, theta, neighbours, graph_neighbours, share, 0.05, 0.0, anchors_near, seed)


# Anchor graphs that are learned.

_ROWS = "sample_id long, features array<double>, near array<int>, z array<double>"


def _rows(batch: pa.RecordBatch, near: np.ndarray, z: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(z.tolist(), pa.list_(pa.float64()))], names=["sample_id", "features", "near", "z"])


def _ball_anchors(members: DataFrame, limit: int = MAX_ANCHORS) -> np.ndarray:
    return balls.collect_balls(balls.centers(members), limit)["center"].astype(float)


def _gram(state: DataFrame, m: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Column sums of Z, and (Z q^power)' (Z q^power) by aggregates over pairs of a row's entries."""
    q = np.zeros(m)
    for r in state.select(F.explode(F.arrays_zip("near", "z")).alias("e")).groupBy("e.near").agg(F.sum("e.z").alias("s")).collect():
        q[r.near] = r.s
    both = state.select("sample_id", F.arrays_zip("near", "z").alias("e")).select(F.explode("e").alias("x"), "e").select("x", F.explode("e").alias("y"))
    g = np.zeros((m, m))
    for r in both.groupBy(F.col("x.near").alias("a"), F.col("y.near").alias("b")).agg(F.sum(F.col("x.z") * F.col("y.z")).alias("s")).collect():
        g[r.a, r.b] = r.s
    scale = np.where(q > 0, (q + np.finfo(float).eps) ** power, 0.0)
    return q, scale[:, None] * g * scale[None, :]


def _over(share: float, variance: float) -> float:
    return share / variance if variance > 0 else math.inf


def mgagc(samples: DataFrame, k: int, near: int = 5, beta: float = 1.0, weight: float = 1.0, min_points: int = 2, rounds: int = 20, tolerance: float = 1e-4, seed: int = 0) -> DataFrame:
    """Learned graph of samples and anchors until it has k components; labels are its components.

    Feature weights, rows of the graph and spectral coordinates take turns; the graph of least objective stays unless one has k
    components, where anchors without ties count as components. A row's spectral coordinates follow from its entries
    and the eigenvectors of the anchors' Gram matrix, so no sample-sized matrix exists. A ball is split if the
    children's adaptive densities, their shares over the variances of their radii, sum to at least its own; the
    first ball of a task counts as having none.
    """

    def kernel(x: np.ndarray) -> np.ndarray:
        number, done = np.zeros(len(x), np.int64), 0
        stack = [(np.arange(len(x)), 0.0)]
        while stack:
            who, share = stack.pop()
            part = x[who]
            left = K.by_two_means(part, seed) if len(who) > min_points else None
            if left is not None and min(left.sum(), (~left).sum()) > min_points:
                shares = (left.mean(), 1 - left.mean())
                children = sum(_over(s, K.radii(part[side]).var()) for s, side in zip(shares, (left, ~left)))
                if children >= _over(share, K.radii(part).var()):
                    stack += [(who[~left], shares[1]), (who[left], shares[0])]
                    continue
            number[who] = done
            done += 1
        return number

    a = _ball_anchors(balls.generate(samples, kernel))
    m, near = len(a), min(near, len(a))
    w = np.full(a.shape[1], 1.0 / a.shape[1])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = K.pairwise(_matrix(batch, 1) * w, a * w) ** 2
            at = np.argsort(d, axis=1, kind="stable")[:, :near]
            v = 1 / (np.take_along_axis(d, at, 1) + 1e-6)
            yield _rows(batch, at, v / v.sum(1, keepdims=True))

    def residual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(a.shape[1])
        for batch in batches:
            x, at, z = _matrix(batch, 1), _matrix(batch, 2), _matrix(batch, 3)
            for c in range(at.shape[1]):
                total += (z[:, c : c + 1] * (x - a[at[:, c]]) ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["f", "s"])

    def update(w: np.ndarray, q: np.ndarray, v: np.ndarray, s: np.ndarray, scale: float):
        anchor_f = v / np.sqrt(q + 1e-10)[:, None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, at, z = _matrix(batch, 1), _matrix(batch, 2).astype(int), _matrix(batch, 3)
                u = np.einsum("nk,nkc->nc", z / np.sqrt(q[at] + 1e-10), v[at]) / s
                d = K.pairwise(x * w, a * w) ** 2 + scale * K.pairwise(u, anchor_f) ** 2
                new = np.argsort(d, axis=1, kind="stable")[:, :near]
                local = np.take_along_axis(d, new, 1)
                eta = (1 + local.sum(1, keepdims=True) / (2 * beta)) / near
                value = np.maximum(eta - local / (2 * beta), 0)
                sums = value.sum(1, keepdims=True)
                yield _rows(batch, new, np.where(sums > 0, value / np.where(sums > 0, sums, 1), 0.0))

        return run

    c = min(k, m)

    def seen(state: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        """Column sums, the leading singular vectors and values of the normalised graph, residuals of the features, squares."""
        q, g = _gram(state, m, -0.5)
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        total = np.zeros(a.shape[1])
        for r in state.mapInArrow(residual, "f int, s double").groupBy("f").agg(F.sum("s").alias("s")).collect():
            total[r.f] = r.s
        squares = state.agg(F.sum(F.aggregate("z", F.lit(0.0), lambda t, z: t + z * z))).first()[0]
        return q, vectors[:, -c:], np.sqrt(np.maximum(values[-c:], 1e-12)), total, float(squares or 0.0)

    def objective(s: np.ndarray, total: np.ndarray, squares: float) -> float:
        return float((w * w * total).sum()) + beta * squares + scale * float(2 * c - 2 * s.sum())

    scale = weight
    state = best = session.materialize(samples.select("sample_id", "features").mapInArrow(first, _ROWS), "z")
    q, v, s, total, squares = seen(state)
    least = before = objective(s, total, squares)
    for _ in range(rounds):
        w = 1 / np.maximum(total, 1e-12)
        w /= w.sum()
        state = session.materialize(state.select("sample_id", "features", "near", "z").mapInArrow(update(w, q, v, s, scale), _ROWS), "z")
        count = int(_anchor_parts(state, m).max()) + 1
        if count == k:
            best = state
            break
        q, v, s, total, squares = seen(state)
        cost = objective(s, total, squares)
        scale = float(np.clip(scale * (2.0 if count < k else 0.5), 1e-6, 1e6))
        if cost < least:
            least, best = cost, state
        if abs(before - cost) < tolerance:
            break
        before = cost
    part = _anchor_parts(best, m)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, z = _matrix(batch, 2).astype(int), _matrix(batch, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part[at[np.arange(len(at)), z.argmax(1)]].astype(np.int32))], names=["sample_id", "label"])

    return best.mapInArrow(label, "sample_id long, label int")


def _links(state: DataFrame) -> DataFrame:
    kept = F.transform(F.filter(F.arrays_zip("near", "z"), lambda e: e["z"] > 1e-6), lambda e: e["near"])
    return state.select(F.array_sort(kept).alias("near")).where("size(near) > 0")


def _anchor_parts(state: DataFrame, m: int) -> np.ndarray:
    """Components of the anchors that samples tie together."""
    ties = _links(state).select(F.col("near")[0].alias("a"), F.explode("near").alias("b")).distinct().collect()
    adjacent = np.eye(m, dtype=bool)
    for r in ties:
        adjacent[r.a, r.b] = adjacent[r.b, r.a] = True
    return K.components(adjacent)


def agc_ild(samples: DataFrame, k: int, anchors: int = 32, near: int = 5, beta: float = 0.1, rounds: int = 30, tolerance: float = 1e-6, seed: int = 1) -> DataFrame:
    """Balanced anchors, a graph with as many ties as the density asks for, labels of anchors by coordinate ascent.

    The anchors are leaves of a tree of balanced soft two-means of depth log2(anchors), seeded by what a node holds.
    """
    n = samples.count()
    spread = scaling.long_form(samples).groupBy("f").agg(F.var_pop("v").alias("v")).agg(F.avg("v")).first()[0]
    alpha = 2.0 / max(spread, np.finfo(float).eps)
    depth = max(1, int(math.log2(max(2, min(anchors, n)))))
    bound = max(1, math.ceil(n / 2**depth))

    def halves(x: np.ndarray) -> np.ndarray | None:
        if len(x) <= bound or len(x) < 2:
            return None
        rng = np.random.default_rng(zlib.crc32(np.ascontiguousarray(x).tobytes()) ^ seed)
        c = x[rng.integers(len(x), size=2)].astype(float)
        tiny = np.finfo(float).eps
        for _ in range(100):
            d = 0.5 * K.pairwise(x, c) ** 2
            soft = np.exp(-alpha * (d - d.min(1, keepdims=True)))
            soft /= soft.sum(1, keepdims=True)
            push = math.exp(-alpha * abs(float(d[:, 0].mean() - d[:, 1].mean())))
            bent = np.maximum(soft * (1 + push * (d - d.mean(1, keepdims=True))), tiny)
            order = np.argsort(bent[:, 0] - bent[:, 1], kind="stable")
            sides = order[: len(x) // 2], order[len(x) // 2 :]
            new = np.stack([(bent[s, i] @ x[s]) / (bent[s, i].sum() + tiny) for i, s in enumerate(sides)])
            moved = np.sqrt(((new - c) ** 2).sum(1)).max()
            c = new
            if moved < 1e-5:
                break
        left = np.zeros(len(x), bool)
        left[sides[0]] = True
        return left

    a = _ball_anchors(balls.generate(samples, lambda x: K.split_all(x, halves)))
    m = len(a)
    want = min(near, m)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiny = np.finfo(float).eps
        for batch in batches:
            d = K.pairwise(_matrix(batch, 1), a) ** 2
            order = np.argsort(d, axis=1, kind="stable")
            s = np.take_along_axis(d, order, 1)
            level = s[:, :want].mean(1) + tiny
            count = np.minimum(want + np.floor(level / np.maximum(s.mean(1), tiny)).astype(int), m)
            edge = np.where(count == m, s[:, -1] + tiny, s[np.arange(len(s)), np.minimum(count, m - 1)])
            inside = np.arange(m)[None, :] < count[:, None]
            gap = np.where(inside, (edge[:, None] - s) / level[:, None], 0.0)
            total = gap.sum(1, keepdims=True)
            z = np.where(total > 0, gap / np.where(total > 0, total, 1), inside / count[:, None])
            most = int(count.max())
            yield _rows(batch, order[:, :most], z[:, :most])

    state = session.materialize(samples.select("sample_id", "features").mapInArrow(tie, _ROWS), "z")
    q, gram = _gram(state, m, -0.25)
    u = _ascend(gram, k, beta, rounds, tolerance, seed)
    scale = np.where(q > 0, (q + np.finfo(float).eps) ** -0.25, 0.0)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, z in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                out.append(int(np.bincount(u[at], np.array(z) * scale[at], minlength=k).argmax()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["sample_id", "label"])

    return state.mapInArrow(label, "sample_id long, label int")


def _ascend(gram: np.ndarray, k: int, beta: float, rounds: int, tolerance: float, seed: int) -> np.ndarray:
    """Labels of anchors that raise the sum of root energies of the clusters plus beta over their sizes."""
    m = len(gram)
    label = np.random.default_rng(seed).integers(k, size=m)
    label[: min(k, m)] = np.arange(min(k, m))
    count = np.bincount(label, minlength=k).astype(float)
    tie = np.stack([gram[:, label == c].sum(1) for c in range(k)], axis=1)
    energy = np.array([tie[label == c, c].sum() for c in range(k)])
    value = [0.0, float(np.sqrt(np.maximum(energy, 0)).sum() + beta * (1 / np.maximum(count, 1)).sum())]
    for _ in range(rounds):
        for i in range(m):
            old = label[i]
            if count[old] == 1:
                continue
            more = energy + 2 * tie[i] + gram[i, i]
            more[old] = energy[old]
            less = energy.copy()
            less[old] = energy[old] - 2 * tie[i, old] + gram[i, i]
            gain = np.sqrt(np.maximum(more, 0)) - np.sqrt(np.maximum(energy, 0)) + beta * (1 / (count + 1) - 1 / np.maximum(count, 1))
            gain[old] = math.sqrt(max(energy[old], 0)) - math.sqrt(max(less[old], 0)) + beta * (1 / count[old] - 1 / (count[old] - 1))
            new = int(gain.argmax())
            if new != old:
                energy[old], energy[new] = less[old], more[new]
                count[old] -= 1
                count[new] += 1
                tie[:, old] -= gram[:, i]
                tie[:, new] += gram[:, i]
                label[i] = new
        value.append(float(np.sqrt(np.maximum(energy, 0)).sum() + beta * (1 / np.maximum(count, 1)).sum()))
        if abs(value[-2] - value[-3]) < tolerance:
            break
    return label
