"""The most similar vectors of every vector, by a hierarchical k-means tree searched best bin first.

Each dataset gets a tree of k-means splits, fitted on a bounded sample of its vectors (``TREE_SAMPLE`` in
expectation); every vector is sent down the tree into its leaf. A query takes nodes out of a queue in the order of a
lower bound of their distance (the largest gap to a splitting plane on the way down): an inner node puts its
children into the queue, a leaf is searched, and no node is taken whose bound exceeds the distance of the k-th
neighbour so far. How many leaves a query may visit is calibrated per dataset: a bounded sample of queries visits all
leaves its bounds allow, which is exact, and the number of visits is doubled from 1 until it finds ``TARGET`` of their
neighbours. ``exact`` sets no such number.

Datasets of at most ``WHOLE`` vectors are searched in one task each, so the k-th neighbour tightens after every leaf. Of
larger ones a query first meets its own leaf; the other visits are then spread over tasks, each of which gets a
bounded part of a leaf (``PART`` members) and of its visitors (``VISITORS``), so a leaf that many want is no task of its own.

Equal vectors are searched once. Distances are exact; of equal ones the smaller sample comes first.

Defined results for odd input: unusable samples and unknown datasets have no neighbours and are none; repeated
rows are one sample; copies of a vector are neighbours at distance 0; ``y`` is not read; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.llm.vectors import distinct_vectors, exact, matrix, sorted_groups, usable_samples

K = 5
WHOLE = 8192
LEAF = 1024
LOCAL_LEAF = 128
PART, VISITORS = 8192, 16_384
BRANCH = 8
TREE_SAMPLE = 32_768
SLICE = 32_768
CALIBRATION = 256
TARGET = 0.9999
_SLACK = 1e-9
_FOUND = "rep long, other long, distance double, visit int"


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, distance) of the k nearest rows of ``x`` at most ``most`` from each query, but itself."""
    if not len(q) or not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    middle = x.mean(0)
    centred, xx = x - middle, ((x - middle) ** 2).sum(1)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 21) // len(x))
    for lo in range(0, len(q), step):
        part, part_ids, bound = q[lo : lo + step], q_ids[lo : lo + step], most[lo : lo + step]
        p = part - middle
        pp = (p * p).sum(1)
        d2 = pp[:, None] + xx[None, :] - 2.0 * (p @ centred.T)
        d2[part_ids[:, None] == ids[None, :]] = np.inf
        slack = 1e-9 * (pp[:, None] + xx.max())
        limit = (bound * bound)[:, None] + slack
        if len(x) > k:
            limit = np.minimum(limit, np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + 2 * slack)
        i, j = np.nonzero(d2 <= limit)
        if not len(i):
            continue
        d = exact(part[i], x[j])
        inside = d <= bound[i]
        i, j, d = i[inside], j[inside], d[inside]
        rank = np.lexsort((ids[j], d, i))
        i, j, d = i[rank], j[rank], d[rank]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        found.append((i[top] + lo, ids[j[top]], d[top]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def _found(rep: np.ndarray, other: np.ndarray, distance: np.ndarray, visit: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(other, pa.int64()), pa.array(distance, pa.float64()), pa.array(visit, pa.int32())], names=["rep", "other", "distance", "visit"])


def _merge(distance: np.ndarray, other: np.ndarray, rows: np.ndarray, i: np.ndarray, ids: np.ndarray, d: np.ndarray, visit: np.ndarray | None = None, at: np.ndarray | None = None) -> None:
    """Merge neighbours ``ids`` at ``d`` of the rows ``rows[i]`` (at most k each, sorted by row) into the k best of each row."""
    k = distance.shape[1]
    if not len(i):
        return
    place = np.arange(len(i)) - np.searchsorted(i, i)
    mine = np.unique(i)
    slot = np.searchsorted(mine, i)
    new_d, new_o = np.full((len(mine), k), np.inf), np.full((len(mine), k), np.iinfo(np.int64).max)
    new_d[slot, place], new_o[slot, place] = d, ids
    who = rows[mine]
    all_d, all_o = np.concatenate([distance[who], new_d], axis=1), np.concatenate([other[who], new_o], axis=1)
    order = np.lexsort((all_o, all_d), axis=1)[:, :k]
    distance[who], other[who] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_o, order, 1)
    if visit is not None:
        when = np.concatenate([visit[who], np.broadcast_to(at[mine][:, None], (len(mine), k))], axis=1)
        visit[who] = np.take_along_axis(when, order, 1)


def searched(tree: Tree, x: np.ndarray, ids: np.ndarray, members: dict[int, np.ndarray], rows: np.ndarray, within: float, k: int, budget: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, other, visit) of the k nearest of each of the given rows of ``x``; visit is the leaf that told, counted from 0."""
    distance, other = np.full((len(rows), k), np.inf), np.full((len(rows), k), np.iinfo(np.int64).max)
    visit = np.zeros((len(rows), k), np.int64)
    q, q_ids = x[rows], ids[rows]
    most = np.full(len(rows), within)

    def meet(leaf: int, who: np.ndarray, visits: np.ndarray) -> None:
        there = members.get(leaf)
        if there is not None:
            i, o, d = nearest(q[who], q_ids[who], x[there], ids[there], most[who], k)
            _merge(distance, other, who, i, o, d, visit, visits)
            most[who] = np.minimum(most[who], distance[who, k - 1])

    tree.best_first(q, most, budget, meet)
    return distance, other, visit


def widened(visit: np.ndarray, found: np.ndarray) -> int:
    """The number of visits, doubled from 1, that finds ``TARGET`` of the neighbours an exact search found."""
    visits, total = 1, max(1, int(found.sum()))
    while (found & (visit < visits)).sum() < TARGET * total:
        visits *= 2
    return visits


def _whole(k: int, leaf: int, exactly: bool):
    """Search of whole datasets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, 1):
            t = t.sort_by("rep")
            ids, x, within = t.column("rep").to_numpy(), matrix(t.column("x")), float(t.column("within")[0].as_py())
            tree = fit_tree(x, leaf)
            own = tree.leaves(x)
            order = np.argsort(own, kind="stable")
            cuts = np.nonzero(np.diff(own[order]))[0] + 1
            members = {int(own[w[0]]): w for w in np.split(order, cuts)}
            some = np.arange(0, len(x), -(-len(x) // CALIBRATION))
            distance, other = np.empty((len(x), k)), np.empty((len(x), k), np.int64)
            distance[some], other[some], visit = searched(tree, x, ids, members, some, within, k, None)
            budget = None if exactly else widened(visit, np.isfinite(distance[some]))
            rest = np.setdiff1d(np.arange(len(x)), some)
            distance[rest], other[rest], _ = searched(tree, x, ids, members, rest, within, k, budget)
            i, j = np.nonzero(np.isfinite(distance))
            yield _found(ids[i], other[i, j], distance[i, j], np.zeros(len(i), np.int32))

    return run


class Tree:
    """Centroids of the children of each inner node; a leaf has none."""

    def __init__(self, children: list[list[int]], centroids: list[np.ndarray]):
        self.children, self.centroids = children, centroids

    def pack(self) -> bytes:
        out = io.BytesIO()
        flat = [c for c in self.centroids if len(c)]
        np.savez(out, sizes=[len(c) for c in self.children], children=np.array([x for c in self.children for x in c], np.int64), centroids=np.concatenate(flat) if flat else np.empty((0, 0)))
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Tree:
        z = np.load(io.BytesIO(data))
        cuts = np.cumsum(z["sizes"])[:-1]
        centroids = np.split(z["centroids"], cuts) if len(z["centroids"]) else [z["centroids"]] * len(z["sizes"])
        return Tree([c.tolist() for c in np.split(z["children"], cuts)], centroids)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, who = todo.pop()
            if not self.children[node]:
                out[who] = node
                continue
            best = _gaps(x[who], self.centroids[node])[0].argmin(1)
            for i, child in enumerate(self.children[node]):
                if (best == i).any():
                    todo.append((child, who[best == i]))
        return out

    def best_first(self, x: np.ndarray, most: np.ndarray, budget: np.ndarray | int | None, meet: Callable[[int, np.ndarray, np.ndarray], None]) -> None:
        """Take the nodes of each row out of its queue, nearest bound first, and ``meet(leaf, rows, visits so far)`` at each leaf.

        A row goes on while the nearest bound in its queue is at most ``most``, which ``meet`` may lower, and it has visited
        fewer than ``budget`` leaves. The queues are rows of a matrix over all nodes.
        """
        step = max(16, (1 << 22) // len(self.children))
        for lo in range(0, len(x), step):
            rows = np.arange(lo, min(len(x), lo + step))
            queue = np.full((len(rows), len(self.children)), np.inf)
            queue[:, 0] = 0.0
            visits = np.zeros(len(rows), np.int64)
            allowed = np.full(len(rows), 1 << 62) if budget is None else np.broadcast_to(budget, len(x))[rows]
            active = np.arange(len(rows))
            while len(active):
                node = queue[active].argmin(1)
                bound = queue[active, node]
                live = bound <= most[rows[active]] * (1 + _SLACK) + _SLACK
                active, node, bound = active[live], node[live], bound[live]
                queue[active, node] = np.inf
                for at in np.unique(node):
                    here = node == at
                    who = active[here]
                    if not self.children[at]:
                        meet(int(at), rows[who], visits[who])
                        visits[who] += 1
                        continue
                    _, gap = _gaps(x[rows[who]], self.centroids[at])
                    queue[who[:, None], np.array(self.children[at])[None, :]] = np.maximum(bound[here][:, None], gap)
                active = active[visits[active] < allowed[active]]

    def visits(self, x: np.ndarray, most: np.ndarray, budget: np.ndarray | int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, visit) of the leaves that may hold a vector at most ``most`` away, nearest bound first, at most ``budget`` a row."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]
        self.best_first(x, most, budget, lambda leaf, who, visits: found.append((who, np.full(len(who), leaf), visits.copy())))
        rows, leaves, visit = (np.concatenate(c) for c in zip(*found))
        return rows, leaves, visit


def _gaps(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to the centroids, and each child's lower bound by the planes between siblings."""
    d2 = ((x[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    apart = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    gap = ((d2[:, :, None] - d2[:, None, :]) / (2 * apart)[None, :, :]).max(2)
    return d2, np.maximum(gap, 0.0)


def fit_tree(x: np.ndarray, leaf: int, branch: int = BRANCH, rounds: int = 6) -> Tree:
    """Split nodes of more than ``leaf`` rows by k-means, largest first, breadth first."""
    rng = np.random.default_rng(1)
    children: list[list[int]] = [[]]
    centroids: list[np.ndarray] = [np.empty((0, x.shape[1]))]
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, who = todo.pop(0)
        parts = int(min(branch, -(-len(who) // max(1, leaf))))
        if parts < 2:
            continue
        part = x[who]
        at = part[rng.integers(len(part))][None, :]
        d2 = ((part - at[0]) ** 2).sum(1)
        while len(at) < parts and d2.max() > 0:
            at = np.concatenate([at, part[rng.choice(len(part), p=d2 / d2.sum())][None, :]])
            d2 = np.minimum(d2, ((part - at[-1]) ** 2).sum(1))
        for _ in range(rounds):
            best = ((part * part).sum(1)[:, None] + (at * at).sum(1)[None, :] - 2 * part @ at.T).argmin(1)
            at = np.stack([part[best == i].mean(0) if (best == i).any() else at[i] for i in range(len(at))])
        at = np.unique(at, axis=0)
        best = _gaps(part, at)[0].argmin(1) if len(part) <= 4096 else np.concatenate([_gaps(part[lo : lo + 4096], at)[0].argmin(1) for lo in range(0, len(part), 4096)])
        used = np.unique(best)
        if len(used) < 2:
            continue
        centroids[node] = at[used]
        for i in used:
            children.append([])
            centroids.append(np.empty((0, x.shape[1])))
            children[node].append(len(children) - 1)
            todo.append((len(children) - 1, who[best == i]))
    return Tree(children, centroids)


def _fit(leaf: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        x = matrix(table.column("x"))
        share = len(x) / table.column("n")[0].as_py()
        tree = fit_tree(x, max(2, int(leaf * share)))
        return pa.table({"dataset_name": [table.column("dataset_name")[0].as_py()], "tree": pa.array([tree.pack()], pa.binary())})

    return run


def _assign(points: pa.Table, trees: pa.Table) -> pa.Table:
    tree = Tree.unpack(trees.column("tree")[0].as_py())
    x = matrix(points.column("x"))
    leaf = np.concatenate([tree.leaves(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)])
    return points.select(["dataset_name", "slice", "rep", "x", "within"]).append_column("leaf", pa.array(leaf, pa.int64()))


_VISITS = "dataset_name string, leaf long, rep long, x array<double>, most double, visit int"


def _visit(points: pa.Table, trees: pa.Table) -> pa.Table:
    schema = pa.schema([("dataset_name", pa.string()), ("leaf", pa.int64()), ("rep", pa.int64()), ("x", pa.list_(pa.float64())), ("most", pa.float64()), ("visit", pa.int32())])
    if not points.num_rows:
        return schema.empty_table()
    tree = Tree.unpack(trees.column("tree")[0].as_py())
    parts = []
    for lo in range(0, points.num_rows, 2048):
        block = points.slice(lo, 2048)
        x, most, own = matrix(block.column("x")), block.column("most").to_numpy(), block.column("leaf").to_numpy()
        budget = np.minimum(block.column("budget").to_numpy().astype(np.int64) + 1, 1 << 40)  # the own leaf is met before
        row, leaf, place = tree.visits(x, most, budget)
        other = leaf != own[row]
        row, leaf, place = row[other], leaf[other], place[other]
        taken = block.take(pa.array(row))
        parts.append(pa.table([taken.column("dataset_name"), pa.array(leaf, pa.int64()), taken.column("rep"), taken.column("x"), taken.column("most"), pa.array(place, pa.int32())], schema=schema))
    return pa.concat_tables(parts)


def _meet(k: int):
    """Visitors of a part of a leaf against its members; members come as visit -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_groups(batches, 4):
            visit = t.column("visit").to_numpy()
            if visit.min() >= 0 or visit.max() < 0:
                continue
            ids, x, most = t.column("rep").to_numpy(), matrix(t.column("x")), t.column("most").to_numpy()
            member = visit < 0
            q = ~member
            i, other, d = nearest(x[q], ids[q], x[member], ids[member], most[q], k)
            yield _found(ids[q][i], other, d, visit[q][i])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    top = F.slice(F.array_sort(F.collect_list(F.struct("distance", "other", "visit"))), 1, k)
    return found.groupBy("rep").agg(top.alias("top")).select("rep", F.explode("top").alias("t")).select("rep", "t.other", "t.distance", "t.visit")


def _large(large: DataFrame, k: int, leaf: int, exactly: bool) -> DataFrame:
    """Neighbours in the datasets that have a tree."""
    share = F.greatest(F.lit(1), F.ceil(F.col("n") / TREE_SAMPLE)).cast("long")
    sample = large.where(F.pmod(F.xxhash64("rep", F.lit(11)), share) == 0)
    trees = session.materialize(sample.groupBy("dataset_name").applyInArrow(_fit(leaf), "dataset_name string, tree binary"), "trees")
    slices = F.ceil(F.col("n") / SLICE).cast("int")
    sizes = large.select("dataset_name", "n").distinct()
    placed = trees.join(sizes, "dataset_name").select("dataset_name", "tree", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    by = ["dataset_name", "slice"]
    points = large.withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(13)), slices).cast("int")).select(*by, "rep", "x", "within")
    kinds = "dataset_name string, slice int, rep long, x array<double>, within double, leaf long"
    leaves = session.materialize(points.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_assign, kinds), "leaves")
    members = leaves.select("dataset_name", "leaf", "rep", "x", "within")
    cut = members.groupBy("dataset_name", "leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("pieces"))
    cut = session.materialize(cut, "pieces")

    def meet(visitors: DataFrame) -> DataFrame:
        """Neighbours of the visitors (dataset_name, leaf, rep, x, most, visit) in the leaves they visit."""
        wanted = visitors.groupBy("dataset_name", "leaf").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
        wanted = session.materialize(wanted, "wanted")
        of = ["dataset_name", "leaf"]
        came = visitors.join(wanted, of).join(cut, of)
        came = came.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(19)), "parts").cast("int")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        stay = members.join(wanted, of).join(cut, of)
        stay = stay.withColumn("piece", F.pmod(F.xxhash64("rep", F.lit(23)), "pieces").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        columns = [*of, "part", "piece", "rep", "x"]
        both = came.select(*columns, "most", "visit").unionByName(stay.select(*columns, F.col("within").alias("most"), F.lit(-1).alias("visit")))
        return session.by_group(both, *of, "part", "piece").mapInArrow(_meet(k), _FOUND)

    own = _best(meet(members.select("dataset_name", "leaf", "rep", "x", F.col("within").alias("most"), F.lit(0).alias("visit"))), k)
    own = session.materialize(own, "own")
    kth = own.groupBy("rep").agg(F.count("*").alias("have"), F.max("distance").alias("far"))
    bounded = leaves.join(kth, "rep", "left").withColumn("most", F.when(F.col("have") >= k, F.least("far", "within")).otherwise(F.col("within")))
    bounded = session.materialize(bounded.select(*by, "leaf", "rep", "x", "most"), "bounded")

    def search(queries: DataFrame, budget: DataFrame | None) -> DataFrame:
        if budget is None:
            told = queries.withColumn("budget", F.lit(1 << 30))
        else:
            told = queries.join(budget, "dataset_name", "left").withColumn("budget", F.coalesce("budget", F.lit(1 << 30)).cast("int"))
        visitors = told.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_visit, _VISITS)
        return _best(meet(session.materialize(visitors, "visitors")).unionByName(own), k)

    if exactly:
        return search(bounded, None)
    few = F.greatest(F.lit(1), F.ceil(F.col("n") / CALIBRATION)).cast("long")
    asked = bounded.join(sizes, "dataset_name").where(F.pmod(F.xxhash64("rep", F.lit(17)), few) == 0).drop("n")
    found = session.materialize(search(asked, None).join(asked.select("rep", "dataset_name"), "rep"), "asked")
    wide = found.groupBy("dataset_name", "visit").agg(F.count("*").alias("n"))
    wide = wide.groupBy("dataset_name").agg(F.sort_array(F.collect_list(F.struct("visit", "n"))).alias("seen"), F.sum("n").alias("all"))
    within = lambda v: F.aggregate("seen", F.lit(0).cast("long"), lambda s, e: s + F.when(e["visit"] < v, e["n"]).otherwise(0))
    widths = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda e: F.pow(F.lit(2), e).cast("int"))
    budget = wide.select("dataset_name", F.get(F.filter(widths, lambda v: within(v) >= TARGET * F.col("all")), F.lit(0)).alias("budget"))
    return search(bounded, session.materialize(budget, "budget"))


def nearest_vectors(vectors: DataFrame, k: int = K, whole: int = WHOLE, leaf: int | None = None, exactly: bool = False) -> DataFrame:
    """(rep, other, distance): the k nearest distinct vectors at most ``within`` away, smaller ids first if equal."""
    sizes = vectors.groupBy("dataset_name").agg(F.count("*").alias("n"))
    sized = session.materialize(vectors.join(sizes, "dataset_name").select("dataset_name", "rep", "x", "within", "n"), "vectors")
    small = session.by_group(sized.where(F.col("n") <= whole).select("dataset_name", "rep", "x", "within"), "dataset_name")
    found = small.mapInArrow(_whole(k, leaf or LOCAL_LEAF, exactly), _FOUND)
    large = sized.where(F.col("n") > whole)
    if not large.isEmpty():
        found = found.unionByName(_large(large, k, leaf or LEAF, exactly))
    return found.select("rep", "other", "distance")


def neighbour_lists(dataset: DataFrame, catalog: DataFrame, k: int = K, whole: int = WHOLE, leaf: int | None = None, exactly: bool = False) -> DataFrame:
    """(sample_id, neighbour, distance, place): at most k nearest similar samples of every usable sample."""
    samples = session.materialize(usable_samples(dataset, catalog), "samples")
    vectors, members = distinct_vectors(samples)
    members = session.materialize(members, "members")
    found = session.materialize(nearest_vectors(vectors, k, whole, leaf, exactly), "found")
    several = members.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
    few = Window.partitionBy("rep").orderBy("sample_id")
    copies = members.join(several, "rep", "left_semi").withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    copies = session.materialize(copies.select("rep", F.col("sample_id").alias("copy")), "copies")
    others = found.join(copies.withColumnRenamed("rep", "other"), "other", "left").select("rep", F.coalesce("copy", "other").alias("id"), "distance")
    listed = others.unionByName(copies.select("rep", F.col("copy").alias("id"), F.lit(0.0).alias("distance")))
    near_first = Window.partitionBy("rep").orderBy("distance", "id")
    listed = listed.withColumn("r", F.row_number().over(near_first)).where(F.col("r") <= k + 1).drop("r")
    each = members.join(listed, "rep").where("id <> sample_id")
    place = Window.partitionBy("sample_id").orderBy("distance", "id")
    return each.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("sample_id", F.col("id").alias("neighbour"), "distance", "place")


def neighbour_pairs(dataset: DataFrame, catalog: DataFrame, k: int = K, whole: int = WHOLE, leaf: int | None = None, exactly: bool = False) -> DataFrame:
    """(sample_a, sample_b): pairs in which at least one is a neighbour of the other, the smaller first."""
    lists = neighbour_lists(dataset, catalog, k, whole, leaf, exactly)
    return lists.select(F.least("sample_id", "neighbour").alias("sample_a"), F.greatest("sample_id", "neighbour").alias("sample_b")).distinct()
