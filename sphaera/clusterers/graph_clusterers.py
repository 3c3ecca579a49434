"""Clusterers over covers, natural neighbours and peeled borders."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.clusterers import kernels as K
from sphaera.clusterers.ball_clusterers import _radius_pass
from sphaera.operators import balls, distance, windows
from sphaera.operators.graph import connected_components

#: Tables of so many samples are covered, and their other balls labelled, in one task; larger ones in rounds of jobs, to the same end.
ONE_TASK = balls.LOCAL


def _centres_at_once(table: pa.Table) -> pa.Table:
    """Centres of a whole table of neighbours (a, b), b null for samples without any."""
    taken: set[int] = set()
    centres: list[int] = []
    held: dict[int, list[int]] = {}
    for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
        held.setdefault(a, []).append(b)
    for a in sorted(held):
        if a not in taken:
            centres.append(a)
            taken.update(held[a])
    return pa.table({"sample_id": pa.array(centres, pa.int64())})


def greedy_centres(ids: DataFrame, near: DataFrame) -> DataFrame:
    """(sample_id): the samples that no earlier centre holds among its neighbours, as if taken one by one in the order of ids.

    Each round takes those as centres that no undecided earlier sample can hold and drops what they hold; the rounds are
    few, as the chains of undecided samples shrink on both sides. near: (a, b).
    """
    if ids.count() <= ONE_TASK:
        all_near = ids.select(F.col("sample_id").alias("a")).join(near.select("a", "b"), "a", "left")
        return session.materialize(all_near.withColumn("whole", F.lit(1)).groupBy("whole").applyInArrow(_centres_at_once, "sample_id long"), "centres")
    undecided = session.materialize(ids.select("sample_id").distinct(), "undecided")
    edges = session.materialize(near.where("a < b").select("a", "b"), "held")
    centres = undecided.limit(0)
    while True:
        fresh = session.materialize(undecided.join(edges.select(F.col("b").alias("sample_id")).distinct(), "sample_id", "left_anti"), "centres")
        centres = centres.unionByName(fresh)
        taken = edges.join(fresh.select(F.col("sample_id").alias("a")), "a", "left_semi").select(F.col("b").alias("sample_id")).distinct()
        undecided = session.materialize(undecided.join(fresh, "sample_id", "left_anti").join(taken, "sample_id", "left_anti"), "undecided")
        if undecided.isEmpty():
            return centres
        open_a, open_b = undecided.select(F.col("sample_id").alias("a")), undecided.select(F.col("sample_id").alias("b"))
        edges = session.materialize(edges.join(open_a, "a", "left_semi").join(open_b, "b", "left_semi"), "held")


def _follow(key: tuple, table: pa.Table) -> pa.Table:
    """Unlabelled members of a ball follow the nearest labelled one, the first in the ball if equal, else the ball's own label."""
    table = table.sort_by("place")
    x, label = distance.rows_of(table.column("features")), table.column("label").to_numpy(zero_copy_only=False).astype(float)
    known, fresh = np.nonzero(~np.isnan(label))[0], np.nonzero(np.isnan(label))[0]
    if len(known):
        given = [int(label[known[int(((x[known] - x[i]) ** 2).sum(1).argmin())]]) for i in fresh]
    else:
        given = [int(table.column("own")[0].as_py())] * len(fresh)
    return pa.table({"sample_id": table.column("sample_id").take(pa.array(fresh, pa.int64())), "label": pa.array(given, pa.int32())})


def _follow_in_turn(table: pa.Table) -> pa.Table:
    """The same for all balls of a table, one after the other; what a ball labels is known to later ones."""
    table = table.sort_by([("ball", "ascending"), ("place", "ascending")])
    x, ball, ids = distance.rows_of(table.column("features")), table.column("ball").to_numpy(), table.column("sample_id").to_pylist()
    label = {i: v for i, v in zip(ids, table.column("label").to_pylist()) if v is not None}
    own, given = table.column("own").to_numpy(), {}
    cuts = [0, *(np.nonzero(np.diff(ball))[0] + 1).tolist(), len(ball)]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        known, fresh = [r for r in range(lo, hi) if ids[r] in label], [r for r in range(lo, hi) if ids[r] not in label]
        for r in fresh:
            given[ids[r]] = label[ids[known[int(((x[known] - x[r]) ** 2).sum(1).argmin())]]] if known else int(own[r])
        label |= {ids[r]: given[ids[r]] for r in fresh}
    return pa.table({"sample_id": pa.array(list(given), pa.int64()), "label": pa.array(list(given.values()), pa.int32())})


def gb_dbscan(samples: DataFrame, k: int = 0, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Covers of nearest neighbours; core balls that meet form clusters, the rest follows near ones; labels 0...

    In the order of ids, a sample that no ball holds yet makes a ball of itself and its int(0.3 ceil(sqrt n)) - 1 nearest
    neighbours. Balls meet on the driver, where only their centres and radii come (about 3.3 sqrt n of them); covers and labels
    stay tables. A sample in several core balls takes the label of the last; balls that are no cores are labelled in their
    order, those that share no unlabelled sample with an earlier one at once.
    """
    n = samples.count()
    size = max(2, int(math.ceil(math.sqrt(n)) * 0.3))
    near = session.materialize(distance.knn(samples, size - 1), "near")
    centres = greedy_centres(samples, near)
    own = centres.select(F.col("sample_id").alias("ball"), "sample_id", F.lit(0).alias("place"))
    around = near.join(centres.select(F.col("sample_id").alias("a")), "a", "left_semi").select(F.col("a").alias("ball"), F.col("b").alias("sample_id"), F.col("rank").alias("place"))
    held = session.materialize(own.unionByName(around).join(samples.select("sample_id", "features"), "sample_id"), "cover")
    s = balls.collect_balls(balls.ball_stats(held))
    name, r, c = s["ball"], s["max_radius"], s["center"]
    bar = np.sort(r)[max(int(len(r) * ratio), 1) - 1]
    core, rest = np.nonzero(r <= bar)[0], np.nonzero(r > bar)[0]
    part = K.components(K.pairwise(c[core], c[core]) <= r[core][:, None] + r[core][None, :])
    nearest = [part[int(((c[core] - c[b]) ** 2).sum(1).argmin())] for b in rest]
    spark = samples.sparkSession
    told = lambda balls_, labels: spark.createDataFrame(pa.table({"ball": pa.array([int(b) for b in balls_], pa.int64()), "own": pa.array([int(x) for x in labels], pa.int32())}))
    label = held.join(told(name[core], part), "ball").groupBy("sample_id").agg(F.max_by("own", "ball").alias("label"))
    label = session.materialize(label, "labels")
    if not len(rest):
        return label
    waiting = session.materialize(held.join(told(name[rest], nearest), "ball"), "waiting")
    if n <= ONE_TASK:
        return label.unionByName(waiting.join(label, "sample_id", "left").withColumn("whole", F.lit(1)).groupBy("whole").applyInArrow(_follow_in_turn, "sample_id long, label int"))
    while True:
        unknown = session.materialize(waiting.join(label, "sample_id", "left"), "unknown")
        fresh = unknown.where("label is null")
        if fresh.isEmpty():
            return label
        first = fresh.groupBy("sample_id").agg(F.min("ball").alias("first"))
        blocked = fresh.join(first, "sample_id").where("first < ball").select("ball").distinct()
        ready = session.materialize(unknown.join(fresh.select("ball").distinct(), "ball", "left_semi").join(blocked, "ball", "left_anti"), "ready")
        given = ready.groupBy("ball").applyInArrow(_follow, "sample_id long, label int")
        label = session.materialize(label.unionByName(given), "labels")
        waiting = session.materialize(waiting.join(ready.select("ball").distinct(), "ball", "left_anti"), "waiting")


def sagbc(samples: DataFrame, k: int = 0, tau: float = 0.1, sample_size: int | None = None, neighbours: int = 5, scale: float = 2.0, seed: int = 1) -> DataFrame:
    """Anchors from a sample, samples to their nearest anchors, clusters of anchors that are near and share samples.

    Labels 0.. are detected; samples whose anchors have no edge get -1. All but the anchors' own graph is
    relational.
    """
    n = samples.count()
    t = min(sample_size or max(2, int(min(20_000, n) * tau)), n)
    bound = max(2, math.ceil(math.sqrt(t))) if sample_size is None else 8
    drawn = samples.orderBy(F.xxhash64("sample_id", F.lit(seed)), "sample_id").limit(t)
    cut = balls.generate(drawn, lambda x: K.split_all(x, lambda y: K.by_first_end(y) if len(y) > bound else None))
    mid = balls.centers(cut).withColumn("sample_id", F.xxhash64("ball"))
    anchors = session.materialize(mid.select("sample_id", "ball", F.col("center").alias("features")), "anchors")
    graph = session.materialize(distance.anchor_graph(samples, anchors, min(neighbours, anchors.count())), "graph")
    radius = graph.groupBy("anchor_id").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("radius"))
    left = graph.select("sample_id", F.col("anchor_id").alias("a"))
    shared = left.join(graph.select("sample_id", F.col("anchor_id").alias("b")), "sample_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    wide = anchors.join(radius, anchors["sample_id"] == radius["anchor_id"])
    at = lambda name: wide.select(F.col("sample_id").alias(name), F.col("features").alias(f"x{name}"), F.col("ball").alias(f"ball_{name}"), F.col("radius").alias(f"r{name}"))
    from sphaera.functions.vectors import distance as apart

    # The anchor that comes first in the order of the balls looks for the other.
    reach = F.when(F.col("ball_a") < F.col("ball_b"), F.col("ra")).otherwise(F.col("rb"))
    edges = shared.join(at("a"), "a").join(at("b"), "b").where(apart(F.col("xa"), F.col("xb")) <= scale * reach)
    parts = connected_components(edges.select("a", "b"))
    number = parts.select("component").distinct().withColumn("label", F.row_number().over(Window.orderBy("component")) - 1)
    labelled = graph.join(parts.join(number, "component"), graph["anchor_id"] == F.col("node"))
    best = labelled.groupBy("sample_id").agg(F.max_by("label", F.struct("w", -F.col("d"), -F.col("anchor_id"))).alias("label"))
    return samples.select("sample_id").join(best, "sample_id", "left").select("sample_id", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))


# Natural neighbours on ball centres.


def nard_balls(samples: DataFrame) -> DataFrame:
    """Two-step farthest splits while the children's weighted mean distance falls; then the wide balls."""

    def measure(x: np.ndarray) -> float:
        return 1.0 if len(x) <= 2 else float(K.radii(x).mean())

    def split(x: np.ndarray) -> np.ndarray | None:
        left = K.by_two_steps(x)
        if left is None:
            return None
        a, b = x[left], x[~left]
        return left if (len(a) * measure(a) + len(b) * measure(b)) / len(x) < measure(x) else None

    return _radius_pass(balls.generate(samples, lambda x: K.split_all(x, split)), K.by_two_steps)


class Levels:
    """Neighbours of points level by level: the nearest other ones, nearest first; no table of all pairs is held."""

    def __init__(self, c: np.ndarray):
        self.c, self.m = c, len(c)
        self.near, self.d = K.nearest(c, min(48, self.m - 1))

    def at(self, level: int) -> np.ndarray:
        """Each point's neighbour of a level, 1 the nearest."""
        if level > self.near.shape[1]:
            self.near, self.d = K.nearest(self.c, min(2 * level, self.m - 1))
        return self.near[:, level - 1]

    def mutual(self, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (a, b), sorted, in which each is among the neighbours of the other up to a level."""
        a, b = np.repeat(np.arange(self.m), levels), self.near[:, :levels].ravel().astype(np.int64)
        code = np.sort((a * self.m + b)[np.isin(a * self.m + b, b * self.m + a)])
        return code // max(self.m, 1), code % max(self.m, 1)


class Natural:
    """Natural neighbours, groups and densities of a set of points.

    Groups are sets of natural neighbours joined while two share more than one point. A point's set and those of its
    natural neighbours share both, so groups are the components of these pairs. Wide neighbours, which are natural ones over at most
    three steps, are made for ``ROWS`` points at a time or fewer, and of their steps at most about ``STEPS`` are held.
    """

    ROWS = 64
    STEPS = 1 << 20

    def __init__(self, c: np.ndarray):
        self.c, m = c, len(c)
        self.levels = Levels(c)
        known, lonely, last = np.zeros(m, bool), 0, 0
        for last in range(1, m):
            known[self.levels.at(last)] = True
            now = int((~known).sum())
            if now == lonely:
                break
            lonely = now
        self.pairs = self.levels.mutual(last)
        self.start = np.searchsorted(self.pairs[0], np.arange(m + 1))
        self.group = K.edge_components(m, *self.pairs)
        self.groups = int(self.group.max()) + 1 if m else 0
        self.density = self._density()

    def _step(self, who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(who, natural neighbour of at), once for each neighbour."""
        count = self.start[at + 1] - self.start[at]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(who, count), self.pairs[1][np.repeat(self.start[at], count) + place]

    def wide(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) of all points and their wide neighbours, in blocks of points."""
        m = len(self.c)
        step = max(1, min(self.ROWS, self.STEPS // max(1, m)))
        for lo in range(0, m, step):
            rows = np.arange(lo, min(lo + step, m))
            met = np.zeros((len(rows), m), bool)
            i, j = rows - lo, rows
            for _ in range(3):
                many = np.cumsum(self.start[j + 1] - self.start[j])
                cuts = np.searchsorted(many, np.arange(self.STEPS, many[-1] if len(many) else 0, self.STEPS))
                for part_i, part_j in zip(np.split(i, cuts), np.split(j, cuts)):
                    met[self._step(part_i, part_j)] = True
                i, j = np.nonzero(met)
            i, j = i[i + lo != j] + lo, j[i + lo != j]
            yield i, j, K.apart(self.c, i, j)

    def reached(self, at: np.ndarray) -> np.ndarray:
        """Points that are wide neighbours of any of some points, or one of them."""
        for _ in range(3):
            at = np.union1d(at, self._step(at, at)[1])
        return at

    def _density(self) -> np.ndarray:
        m = len(self.c)
        if not m:
            return np.zeros(0)
        total, count = np.zeros(m), np.zeros(m)
        for i, _, d in self.wide():
            total += np.bincount(i, d, m)
            count += np.bincount(i, minlength=m)
        g = np.full(m, 1e-7)
        np.divide(count, total, out=g, where=total > 0)
        h = g.copy()
        for i, j, d in self.wide():
            h += np.bincount(i[d > 0], g[j[d > 0]] / d[d > 0], m)
        most = np.zeros(self.groups)
        np.maximum.at(most, self.group, h)
        return h / most[self.group]


def _nard(samples: DataFrame, finish) -> DataFrame:
    members = nard_balls(samples)
    s = balls.collect_balls(balls.ball_stats(members), None)
    return balls.scatter(members, s["ball"], finish(Natural(s["center"].astype(float)), s))


def dpeak_nard(samples: DataFrame, k: int = 0, seed: int = 0) -> DataFrame:
    """Density peaks with as many centres as there are groups; labels 1.. ."""
    return _nard(samples, lambda z, s: K.point_peaks(z.density, z.c, z.groups) + 1)


def dbscan_nard(samples: DataFrame, k: int = 0, factor: float = 0.25, seed: int = 0) -> DataFrame:
    """Balls dense enough grow clusters over their wide neighbours; labels 0.., -1 for noise."""

    def finish(z: Natural, s: dict) -> np.ndarray:
        core = z.density >= factor * z.density.mean()
        label = np.full(len(core), -1)
        count = 0
        for i in np.nonzero(core)[0]:
            if label[i] >= 0:
                continue
            fresh = np.array([i])
            label[i] = count
            while len(fresh):
                met = z.reached(fresh)
                met = met[label[met] < 0]
                label[met] = count
                fresh = met[core[met]]
            count += 1
        return label

    return _nard(samples, finish)


def dadc_nard(samples: DataFrame, k: int = 0, seed: int = 0) -> DataFrame:
    """Balls of the greatest density of a group are centres; the others follow the nearest denser; labels 0.. ."""

    def finish(z: Natural, s: dict) -> np.ndarray:
        label = np.full(len(z.c), -1)
        peaks = np.nonzero(z.density >= 1.0)[0]
        label[peaks] = np.arange(len(peaks))
        order = np.argsort(-z.density, kind="stable")
        _, parent = K.nearest_earlier(z.c, order)
        for i in order:
            if label[i] < 0:
                label[i] = label[parent[i]] if parent[i] >= 0 else 0
        return label

    return _nard(samples, finish)


def hcdc_nard(samples: DataFrame, k: int = 0, small: float = 0.01, seed: int = 0) -> DataFrame:
    """Representatives by neighbours' votes, cores that own each other's members joined, then single links.

    Clusters are joined until as many are left as there are groups; those of less than ``small`` of the balls
    are noise. Labels 1.., 0 for noise.
    """

    def finish(z: Natural, s: dict) -> np.ndarray:
        m = len(z.c)
        near, natural = _mutual_levels(z.levels)
        density = np.zeros(m)
        for i in range(m):
            own = near[i]
            for j in natural[i]:
                other = near[j]
                both = own.keys() & other.keys()
                if both:
                    density[i] += len(both) ** 2 / max((sum(own[o] for o in both) + sum(other[o] for o in both)) * (own[j] + 0.01), 1e-300)
        votes: list[Counter] = [Counter() for _ in range(m)]
        for i in range(m):
            own = near[i]
            top = max(own, key=lambda j: (density[j], -j))
            for j in own:
                votes[j][top] += 1
        rep = np.arange(m)
        for i in range(m):
            if votes[i]:
                most = max(votes[i].values())
                rep[i] = min((v for v, n in votes[i].items() if n == most), key=lambda v: (math.dist(z.c[i], z.c[v]) * abs(density[i] - density[v]), v))
        for i in range(m):
            seen, at = [], i
            while rep[at] != at and at not in seen:
                seen.append(at)
                at = int(rep[at])
            rep[at] = at
            rep[seen] = at
        votes.clear()
        _join_cores(rep, density, _owned(rep, natural))
        owned = _owned(rep, natural)
        cores = sorted(owned)
        part = _single_links(z.c[cores], *_core_ties(cores, owned, rep, density, z.c), max(1, z.groups))
        cluster = part[np.searchsorted(cores, rep)]
        kept = np.bincount(cluster, minlength=int(part.max()) + 1 if len(part) else 0) >= small * m
        return np.where(kept, np.cumsum(kept), 0)[cluster]

    return _nard(samples, finish)


class _Made:
    """A list whose members are made when they are asked for, and not kept."""

    def __init__(self, make):
        self.make = make

    def __getitem__(self, i: int):
        return self.make(i)


def _mutual_levels(levels: Levels) -> tuple[_Made, _Made]:
    """Distances of neighbours up to the level at which twice as many points as before have no reverse neighbour, self included; mutual ones."""
    m = levels.m
    known = np.zeros(m, bool)
    before, stable, last = -1, 0, 0
    for last in range(1, m):
        known[levels.at(last)] = True
        lonely = int((~known).sum())
        stable = stable + 1 if lonely == before else 1
        before = lonely
        if lonely == 0 or stable >= 2:
            break
    a, b = levels.mutual(last)
    start = np.searchsorted(a, np.arange(m + 1))
    near = _Made(lambda i: {i: 0.0} | dict(zip(levels.near[i, :last].tolist(), levels.d[i, :last].tolist())))
    return near, _Made(lambda i: set(b[start[i] : start[i + 1]].tolist()))


def _owned(rep: np.ndarray, natural: _Made) -> dict[int, set[int]]:
    """What each core holds: the members it represents and their natural neighbours."""
    out: dict[int, set[int]] = {}
    for i, c in enumerate(rep.tolist()):
        out.setdefault(c, set()).update({i}, natural[i])
    return out


def _join_cores(rep: np.ndarray, density: np.ndarray, owned: dict[int, set[int]]) -> None:
    """Cores from the sparsest on join the densest denser one that holds them or is held by them, with all they hold."""
    held = {c: {o for o in of if o in owned} for c, of in owned.items()}
    holders: dict[int, set[int]] = {c: set() for c in owned}
    for c, of in held.items():
        for o in of:
            holders[o].add(c)
    for low in sorted(owned, key=lambda c: (density[c], c)):
        high = min((h for h in held[low] | holders[low] if density[h] > density[low] and rep[h] == h), key=lambda h: (-density[h], h), default=None)
        if high is not None:
            rep[rep == low] = high
            for o in held[low] - held[high]:
                held[high].add(o)
                holders[o].add(high)


def _core_ties(cores: list[int], owned: dict[int, set[int]], rep: np.ndarray, density: np.ndarray, c: np.ndarray) -> tuple[list[dict[int, float]], float]:
    """Distances of cores that share anything, by place, less for those that share much; and the factor of distance for those that share nothing."""
    place = {core: i for i, core in enumerate(cores)}
    count = np.bincount(rep, minlength=len(c))[cores]
    mean = np.bincount(rep, density, len(c))[cores] / count
    size = [len(owned[core]) for core in cores]
    holders: dict[int, list[int]] = {}
    for core in cores:
        for o in owned[core]:
            holders.setdefault(o, []).append(place[core])
    shared: Counter = Counter()
    for of in holders.values():
        shared.update((a, b) for x, a in enumerate(of) for b in of[x + 1 :])
    ties: list[dict[int, float]] = [{} for _ in cores]
    penalty = 1.0
    for (a, b), n in shared.items():
        level = 2 * math.sqrt(mean[a] * mean[b])
        uneven = (mean[a] + mean[b]) / level if level > 0 else 1e6
        ties[a][b] = ties[b][a] = math.dist(c[cores[a]], c[cores[b]]) * max(size[a], size[b]) * uneven / n**2
        penalty = max(penalty, size[a] * size[b] / n**2)
    return ties, penalty * K.widest(c[cores])


def _single_links(c: np.ndarray, ties: list[dict[int, float]], factor: float, least: int) -> np.ndarray:
    """Cluster numbers, in the order of their first points, after the shortest links are made until ``least`` clusters are left.

    Links are those of a minimal tree; it grows from the first point, with one row of distances at a time.
    """
    m = len(c)
    best, source = np.full(m, np.inf), np.zeros(m, np.int64)
    out = np.zeros(m, bool)
    links: list[tuple[float, int, int]] = []
    at = 0
    for _ in range(m - 1):
        out[at] = True
        far = factor * np.sqrt(((c - c[at]) ** 2).sum(1))
        far[list(ties[at])] = list(ties[at].values())
        nearer = (far < best) & ~out
        best[nearer], source[nearer] = far[nearer], at
        at = int(np.where(out, np.inf, best).argmin())
        links.append((float(best[at]), *sorted((at, int(source[at])))))
    made = np.array([link[1:] for link in sorted(links)[: max(0, m - least)]], np.int64).reshape(-1, 2)
    return K.edge_components(m, made[:, 0], made[:, 1])


# Three-way clustering by peeling borders.


def _within(files: distance.Corpus):
    """Links of samples to those of a corpus within their threshold, as a forest; the nearest one is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        asked = [b for b in batches if b.num_rows]
        for block in distance.read_blocks(files, ["sample_id", "features"]) if asked else ():
            ids, x = block.column(0).to_numpy(), distance.rows_of(block.column(1))
            out: list[tuple[int, int]] = []
            for batch in asked:
                a = batch.column(0).to_numpy()
                q = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
                limit, skip = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
                step = max(1, (1 << 22) // len(ids))
                for lo in range(0, len(a), step):
                    d = K.pairwise(q[lo : lo + step], x)
                    i, j = np.nonzero(d <= limit[lo : lo + step, None])
                    for p, r, s in zip(a[lo + i].tolist(), ids[j].tolist(), skip[lo + i].tolist()):
                        if p != r and r != s and find(p) != find(r):
                            root[find(p)] = find(r)
                            out.append((p, r))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return run


def m3w(samples: DataFrame, k: int = 0, neighbours: int = 8, levels: int = 3, share: float = 0.1, expand: float = 1.6, core_share: float = 0.6, gap: float = 0.0, stop: float = 0.01, skip_first: bool = True, seed: int = 0) -> DataFrame:
    """Three-way clustering: peel sparse borders, link the cores, give the layers back from the inside out.

    Each level is one set of Spark jobs: weighted reverse neighbours, a threshold, and thresholds of the next level
    from the nearest peeled samples. Cores within each other's thresholds are components, of which those of at least
    two samples are clusters. A peeled sample whose nearest cores mostly lie in one cluster becomes a core of it;
    others belong to every cluster that is as frequent. The hard label is the greatest cluster number, -1 for none.
    ``skip_first`` leaves the nearest core out when cores are linked.
    """
    n = samples.count()
    all_near = session.materialize(distance.knn(samples, neighbours), "near")
    bound = distance.link_threshold(all_near).first()[0]
    current = session.materialize(samples.select("sample_id", "features").withColumn("limit", F.lit(bound)), "level")
    layers: list[DataFrame] = []
    for level in range(levels):
        near = all_near if level == 0 else distance.knn(current, neighbours)
        value = current.join(distance.reverse_density(near).withColumnRenamed("b", "sample_id"), "sample_id", "left").select("sample_id", F.coalesce(F.round("density", 12), F.lit(0.0)).alias("value"))
        inner = session.materialize(windows.border_filter(value, "value", share).select("sample_id"), "inner")
        core, border = current.join(inner, "sample_id", "left_semi"), current.join(inner, "sample_id", "left_anti")
        if core.isEmpty() or border.isEmpty():
            break
        link = distance.knn_join(border, core, 1, skip_same=False).select(F.col("a").alias("sample_id"), "d")
        limit = F.when(F.col("d") <= F.col("limit"), F.col("d")).otherwise(F.col("limit"))
        border = session.materialize(border.join(link, "sample_id").select("sample_id", "features", limit.alias("limit")), "border")
        layers.append(border)
        peeled = border if len(layers) == 1 else layers[-1].unionByName(peeled)
        close = distance.knn_join(core, peeled, neighbours, skip_same=False).select(F.col("a").alias("sample_id"), F.col("b").alias("p"))
        mean = close.join(peeled.select(F.col("sample_id").alias("p"), F.col("limit").alias("l")), "p").groupBy("sample_id").agg(F.avg("l").alias("m"), F.count("*").alias("c"))
        grown = F.when(F.col("c") >= neighbours, F.least(F.lit(expand) * F.col("m"), F.lit(bound))).otherwise(F.col("limit"))
        current = session.materialize(core.join(mean, "sample_id", "left").select("sample_id", "features", F.coalesce(grown, F.col("limit")).alias("limit")), "level")
        if current.count() < stop * n:
            break
    first = distance.knn(current, 1).select(F.col("a").alias("sample_id"), F.col("b").alias("nearest"))
    told = current.join(first, "sample_id", "left").select("sample_id", "features", "limit", (F.col("nearest") if skip_first else F.lit(None).cast("long")).alias("nearest"))
    told = session.materialize(told.withColumn("nearest", F.coalesce("nearest", F.lit(-1))), "cores")
    edges = told.mapInArrow(_within(distance.write_corpus(current.select("sample_id", "features"))), "a long, b long")
    parts = connected_components(edges)
    number = parts.select("component").distinct().withColumn("cluster", (F.row_number().over(Window.orderBy("component")) - 1).cast("int"))
    core = session.materialize(current.select("sample_id", "features").join(parts.join(number, "component").select(F.col("node").alias("sample_id"), "cluster"), "sample_id", "left"), "core")
    count = number.count()
    hard = core.select("sample_id", F.coalesce("cluster", F.lit(-1)).alias("label"))
    for border in reversed(layers):
        close = distance.knn_join(border, core, neighbours, skip_same=False).select(F.col("a").alias("sample_id"), F.col("b").alias("c"))
        votes = close.join(core.select(F.col("sample_id").alias("c"), "cluster"), "c").groupBy("sample_id", "cluster").agg((F.count("*") / neighbours).alias("part")).where("cluster is not null")
        best = votes.groupBy("sample_id").agg(F.max("part").alias("top"), F.max_by("cluster", F.struct("part", -F.col("cluster"))).alias("first"))
        ties = votes.join(best, "sample_id").where(F.col("top") - F.col("part") <= gap / max(count, 1)).groupBy("sample_id", "top", "first").agg(F.count("*").alias("n"), F.max("cluster").alias("last"))
        sure = (F.col("top") >= core_share) | (F.col("n") <= 1)
        chosen = session.materialize(ties.select("sample_id", F.when(sure, F.col("first")).otherwise(F.greatest("first", "last")).alias("label"), sure.alias("sure"), "first"), "chosen")
        hard = hard.unionByName(border.select("sample_id").join(chosen.select("sample_id", "label"), "sample_id", "left").select("sample_id", F.coalesce("label", F.lit(-1)).alias("label")))
        added = border.select("sample_id", "features").join(chosen.where("sure").select("sample_id", F.col("first").alias("cluster")), "sample_id")
        core = session.materialize(core.unionByName(added), "core")
    return hard
