"""Clusters of mutually similar vectors by MinHash banding, verified pairs and connected components.

A vector becomes a set of tokens: for each coordinate and each of a few shifted grids, the cell it falls in. The
cells are so wide (``CELL`` / sqrt(width) times ``similar_within``) that two vectors ``similar_within`` apart
share five of six tokens on average, a Jaccard similarity of 0.71; with ``ROWS`` hashes a band and ``BANDS`` bands
such a pair meets in some band with a probability of 0.9998 or more in any width and direction (measured, see the
tests), closer pairs more often, and clusters have many pairs.
Pairs that meet are verified; the statement of the task makes Euclidean distance the exact criterion, so it
takes the place of the Jaccard verification.

Datasets that fit in a task are banded and verified there. Larger ones send each band's buckets to tasks; a
bucket of more than ``BUCKET`` vectors is cut into pieces and every pair of pieces is a task, so no pair is lost.
Tasks report a spanning star of each component they see, never all pairs. How many similar vectors each vector has is
counted afterwards among all vectors of its cluster, block by block where a cluster doesn't fit in a task.

Defined results for odd input: unusable samples and unknown datasets are in no cluster; equal vectors are one
vector with several samples, so copies are similar to each other; repeated rows are one sample; null or wrong
``y`` matter to the agreement only, where null and negative ones are not counted; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.llm.vectors import distinct_vectors, exact, matrix, near, sorted_groups, usable_samples
from sphaera.operators.graph import connected_components, successors

ROWS, BANDS, CELL, LEAST_TOKENS = 3, 32, 6.0, 48
WHOLE = 8192
BUCKET = 8192
LOOSE = 0.5
_SEED = 20240229


def _mix(v: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with fixed multipliers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def band_keys(x: np.ndarray, within: float) -> np.ndarray:
    """(vectors, BANDS) band keys of the MinHash signatures of the vectors' grid tokens."""
    n, width = x.shape
    rng = np.random.default_rng([_SEED, width])
    grids = max(1, -(-LEAST_TOKENS // max(1, width)))
    cell = max(CELL / np.sqrt(width) * within, np.finfo(float).tiny * 1e6)
    tokens = np.empty((n, width * grids), np.uint64)
    for g in range(grids):
        shift = rng.random(width)
        at = np.clip(np.floor(x / cell + shift), -9e18, 9e18).astype(np.int64).view(np.uint64)
        place = _mix(np.arange(width, dtype=np.uint64) + np.uint64(width * g + 1))
        tokens[:, g * width : (g + 1) * width] = _mix(at * np.uint64(0x9E3779B97F4A7C15) + place)
    multiply = rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
    keys = np.empty((n, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(n, b, np.uint64)
        for h in range(b * ROWS, b * ROWS + ROWS):
            key = _mix(key ^ _mix(tokens * multiply[h] + add[h]).min(1))
        keys[:, b] = key
    return keys


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of the given pairs; labels become the least index of each component."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


def _spread(adjacent: np.ndarray) -> np.ndarray:
    """Component labels of a bucket from its adjacency matrix."""
    labels = np.arange(len(adjacent))
    while True:
        least = np.where(adjacent, labels[None, :], len(labels)).min(1)
        least = np.minimum(least, labels)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def link_bands(x: np.ndarray, within: float, keys: np.ndarray) -> np.ndarray:
    """Component labels of vectors that meet in a band and are similar."""
    labels = np.arange(len(x))
    for b in range(keys.shape[1]):
        order = np.argsort(keys[:, b], kind="stable")
        sorted_keys = keys[order, b]
        starts = np.concatenate([[0], np.nonzero(sorted_keys[1:] != sorted_keys[:-1])[0] + 1, [len(x)]])
        sizes = np.diff(starts)
        for size in np.unique(sizes[sizes > 1]):
            at = starts[:-1][sizes == size]
            if size <= 24:
                who = order[at[:, None] + np.arange(size)]
                i, j = np.triu_indices(size, 1)
                p, q = who[:, i].ravel(), who[:, j].ravel()
                apart = labels[p] != labels[q]
                p, q = p[apart], q[apart]
                similar = exact(x[p], x[q]) <= within
                _join(labels, p[similar], q[similar])
                continue
            for start in at:
                who = order[start : start + size]
                if (labels[who] == labels[who[0]]).all():
                    continue
                local = _spread(near(x[who], x[who], within))
                _join(labels, who, who[local])
    return labels


def _ties(x: np.ndarray, ids: np.ndarray, copies: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Degree of each vector and the similar vector of greatest degree, itself included, smaller ids first.

    The degree counts samples: the copies of the similar vectors and the other copies of the vector itself.
    """
    n = len(x)
    degree = np.empty(n, np.int64)
    step = max(1, (1 << 22) // max(1, n))
    for lo in range(0, n, step):
        degree[lo : lo + step] = near(x[lo : lo + step], x, within) @ copies.astype(float) - 1
    place = np.empty(n, np.int64)
    place[np.lexsort((ids, -degree))] = np.arange(n)
    up = np.empty(n, np.int64)
    for lo in range(0, n, step):
        up[lo : lo + step] = np.where(near(x[lo : lo + step], x, within), place[None, :], n).argmin(1)
    return degree, ids[up]


_OUT = "rep long, root long, whole boolean"


def _emit(ids: np.ndarray, labels: np.ndarray, whole: bool) -> pa.RecordBatch | None:
    """A row for each vector of a component of at least two, with its root."""
    _, component, sizes = np.unique(labels, return_inverse=True, return_counts=True)
    roots = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(roots, component, ids)
    of_two = sizes[component] > 1
    if not of_two.any():
        return None
    columns = [pa.array(ids[of_two].astype(np.int64)), pa.array(roots[component][of_two]), pa.array(np.full(int(of_two.sum()), whole))]
    return pa.RecordBatch.from_arrays(columns, names=["rep", "root", "whole"])


def _whole_datasets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, 1):
        ids, x, within = t.column("rep").to_numpy(), matrix(t.column("x")), float(t.column("within")[0].as_py())
        out = _emit(ids, link_bands(x, within, band_keys(x, within)), True)
        if out is not None:
            yield out


def _explode_bands(with_vectors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 1):
            for batch in group.to_batches(max_chunksize=4096):
                x, within = matrix(batch.column(2)), float(batch.column(3)[0].as_py())
                keys = band_keys(x, within)
                for b in range(BANDS):
                    columns = [batch.column(0), pa.array(np.full(len(x), b, np.int32)), pa.array(keys[:, b].view(np.int64)), batch.column(1)]
                    names = ["dataset_name", "band", "key", "rep"]
                    if with_vectors:
                        columns, names = [*columns, batch.column(2), batch.column(3)], [*names, "x", "within"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, 5):
        if t.num_rows < 2:
            continue
        ids, x, within = t.column("rep").to_numpy(), matrix(t.column("x")), float(t.column("within")[0].as_py())
        labels = np.arange(len(x))
        step = max(1, (1 << 24) // len(x))
        if step >= len(x):
            labels = _spread(near(x, x, within))
        else:
            for lo in range(0, len(x), step):
                i, j = np.nonzero(near(x[lo : lo + step], x, within))
                _join(labels, i + lo, j)
        out = _emit(ids, labels, False)
        if out is not None:
            yield out


def similarity_links(vectors: DataFrame, whole: int = WHOLE, bucket: int = BUCKET) -> DataFrame:
    """(rep, root, whole): the components the tasks saw, of each vector that has similar ones."""
    sizes = vectors.groupBy("dataset_name").agg(F.count("*").alias("n"))
    sized = vectors.join(sizes, "dataset_name").select("dataset_name", "rep", "x", "within", "n")
    columns = ["dataset_name", "rep", "x", "within"]
    small = session.by_group(sized.where(F.col("n") <= whole).select(*columns), "dataset_name").mapInArrow(_whole_datasets, _OUT)
    large = sized.where(F.col("n") > whole).select(*columns)
    if large.isEmpty():
        return session.materialize(small, "links")
    by = ["dataset_name", "band", "key"]
    counted = large.sortWithinPartitions("dataset_name").mapInArrow(_explode_bands(False), "dataset_name string, band int, key long, rep long")
    hot = counted.groupBy(*by).agg(F.count("*").alias("m")).where(F.col("m") > bucket).withColumn("pieces", F.ceil(F.col("m") / bucket)).drop("m")
    hot = session.materialize(hot, "hot")
    rows = large.sortWithinPartitions("dataset_name").mapInArrow(_explode_bands(True), "dataset_name string, band int, key long, rep long, x array<double>, within double")
    if hot.isEmpty():
        pieced = rows.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), (F.coalesce("pieces", F.lit(1)) - 1).cast("int")))
        pieced = rows.join(hot, by, "left").withColumn("own", own).withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    keys = [*by, "i", "j"]
    buckets = session.by_group(pieced.select(*keys, "rep", "x", "within"), *keys).mapInArrow(_buckets, _OUT)
    return session.materialize(small.unionByName(buckets), "links")


def _degrees_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in sorted_groups(batches, 1):
        ids = t.column("rep").to_numpy()
        degree, up = _ties(matrix(t.column("x")), ids, t.column("copies").to_numpy(), float(t.column("within")[0].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(degree), pa.array(up)], names=["rep", "degree", "up"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict[str, np.ndarray]], float]]:
    """The two blocks of each pair of blocks; of a block with itself the one."""
    for t in sorted_groups(batches, 1):
        right = t.column("right").to_numpy()
        columns = {"x": matrix(t.column("x"))} | {c: t.column(c).to_numpy() for c in t.column_names if c not in ("pair", "right", "x", "within")}
        yield [{c: v[right == s] for c, v in columns.items()} for s in np.unique(right)], float(t.column("within")[0].as_py())


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sides, within in _sides(batches):
        a, b = sides[0], sides[-1]
        here, there = np.zeros(len(a["rep"]), np.int64), np.zeros(len(b["rep"]), np.int64)
        step = max(1, (1 << 22) // len(there))
        for lo in range(0, len(here), step):
            similar = near(a["x"][lo : lo + step], b["x"], within)
            here[lo : lo + step] = similar @ b["copies"].astype(float)
            there += (a["copies"][lo : lo + step].astype(float) @ similar).astype(np.int64)
        for side, n in [(a, here), (b, there)][: len(sides)]:
            yield pa.RecordBatch.from_arrays([pa.array(side["rep"]), pa.array(n)], names=["rep", "n"])


def _lead_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for sides, within in _sides(batches):
        for a, b in [(sides[0], sides[-1]), (sides[-1], sides[0])][: len(sides)]:
            order = np.lexsort((b["rep"], -b["degree"]))
            ids, degree, y = b["rep"][order], b["degree"][order], b["x"][order]
            step = max(1, (1 << 22) // len(ids))
            for lo in range(0, len(a["rep"]), step):
                similar = near(a["x"][lo : lo + step], y, within)
                some, first = similar.any(1), similar.argmax(1)
                columns = [a["rep"][lo : lo + step][some], ids[first[some]], degree[first[some]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "up", "up_degree"])


def _paired_blocks(rows: DataFrame, bucket: int) -> DataFrame:
    """(rep, pair, right): the pairs of blocks of at most about ``bucket`` vectors in which a vector is compared.

    A cluster is cut into slabs a little more than ``within`` wide along its widest coordinate, so similar
    vectors are in the same or in neighbouring slabs; slabs are cut into pieces.
    """
    spans = rows.select("cluster", F.posexplode("x").alias("at", "v")).groupBy("cluster", "at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    axes = spans.groupBy("cluster").agg(F.max_by(F.struct("at", "low"), F.col("high") - F.col("low")).alias("axis"))
    along = (F.get("x", F.col("axis.at")) - F.col("axis.low")) / (F.col("within") * 1.000001)
    slabs = rows.join(axes, "cluster").select("cluster", "rep", F.when(F.col("within") > 0, F.floor(along)).otherwise(F.lit(0)).cast("long").alias("slab"))
    slabs = session.materialize(slabs, "slabs")
    cut = session.materialize(slabs.groupBy("cluster", "slab").agg(F.ceil(F.count("*") / bucket).cast("int").alias("pieces")), "pieces")
    placed = slabs.join(cut, ["cluster", "slab"]).select("cluster", "rep", "slab", F.pmod(F.xxhash64("rep"), "pieces").cast("int").alias("piece"))
    blocks = cut.select("cluster", "slab", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    other = blocks.select("cluster", F.col("slab").alias("slab_b"), F.col("piece").alias("piece_b"))
    nearby = blocks.withColumn("slab_b", F.explode(F.array(F.col("slab"), F.col("slab") + 1))).join(other, ["cluster", "slab_b"])
    nearby = nearby.where((F.col("slab_b") > F.col("slab")) | (F.col("piece_b") >= F.col("piece")))
    pairs = session.materialize(nearby.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    left = pairs.select("cluster", "slab", "piece", "pair", F.lit(False).alias("right"))
    right = pairs.where("slab_b > slab or piece_b > piece").select("cluster", F.col("slab_b").alias("slab"), F.col("piece_b").alias("piece"), "pair", F.lit(True).alias("right"))
    return placed.join(left.unionByName(right), ["cluster", "slab", "piece"]).select("rep", "pair", "right")


def vector_degrees(vectors: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(rep, degree, up) of vectors (cluster, rep, x, within, copies).

    The degree counts the samples of all similar vectors of the cluster, whatever bands they met in, and the other
    copies of the vector; up is the similar vector of greatest degree, itself included, smaller ids first. Clusters of more than ``bucket`` vectors are cut
    into blocks, of which all that can hold similar vectors are compared: once for the degrees, once for up.
    """
    counts = vectors.groupBy("cluster").agg(F.count("*").alias("m"))
    sized = session.materialize(vectors.join(counts, "cluster").select("cluster", "rep", "x", "within", "copies", "m"), "clustered")
    small = session.by_group(sized.where(F.col("m") <= bucket).drop("m"), "cluster").mapInArrow(_degrees_whole, "rep long, degree long, up long")
    large = sized.where(F.col("m") > bucket).drop("m")
    if large.isEmpty():
        return small
    paired = session.materialize(_paired_blocks(large, bucket), "paired")

    def compared(rows: DataFrame) -> DataFrame:
        return session.by_group(paired.join(rows, "rep").select("pair", "right", *[c for c in rows.columns if c != "cluster"]), "pair")

    degrees = compared(large).mapInArrow(_count_pairs, "rep long, n long").groupBy("rep").agg((F.sum("n") - 1).alias("degree"))
    degrees = session.materialize(degrees, "large-degrees")
    led = compared(large.join(degrees, "rep")).mapInArrow(_lead_pairs, "rep long, up long, up_degree long")
    led = led.groupBy("rep").agg(F.max_by("up", F.struct("up_degree", -F.col("up"))).alias("up"))
    return small.unionByName(degrees.join(led, "rep").select("rep", "degree", "up"))


def clustered_samples(dataset: DataFrame, catalog: DataFrame, least: int = 3, whole: int = WHOLE, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: cluster, sample_id, rep), vectors and samples; clusters are named after their smallest vector."""
    samples = session.materialize(usable_samples(dataset, catalog), "samples")
    vectors, copies = distinct_vectors(samples)
    vectors = session.materialize(vectors, "vectors")
    links = similarity_links(vectors, whole, bucket)
    spread = connected_components(links.where("not whole").select("rep", "root"), "rep", "root")
    labels = links.where("whole").select(F.col("rep").alias("node"), F.col("root").alias("component")).unionByName(spread)
    named = copies.join(labels, copies["rep"] == labels["node"], "left").select("sample_id", "rep", F.coalesce("component", "rep").alias("cluster"))
    named = session.materialize(named, "named")
    sizes = named.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return named.join(sizes, "cluster"), vectors, samples


def cluster_chain(dataset: DataFrame, catalog: DataFrame, whole: int = WHOLE, bucket: int = BUCKET) -> DataFrame:
    """(sample_a, sample_b): each clustered sample with the next larger one of its cluster."""
    members, _, _ = clustered_samples(dataset, catalog, whole=whole, bucket=bucket)
    return successors(members, "cluster", "sample_id").select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"))


def describe_clusters(dataset: DataFrame, catalog: DataFrame, typical: int = 3, whole: int = WHOLE, bucket: int = BUCKET) -> DataFrame:
    """One row a group: cluster, group_id, dataset_name, size, loose, typical and agreement with ``y``.

    A cluster is loose if no member is similar to half of the others, where copies are members of their own. A loose cluster is split: each vector
    follows its similar vector of greatest degree, up to a medoid that has none greater; a group is what leads
    to one medoid, named after the smallest vector of the group. Typical members are those of greatest degree,
    smaller ids first. The agreement is the share of the most frequent ``y`` among the members with a ``y``.
    """
    members, vectors, samples = clustered_samples(dataset, catalog, whole=whole, bucket=bucket)
    members = session.materialize(members, "clusters")
    degrees = vector_degrees(vectors.join(members.where("sample_id = rep").select("cluster", "rep"), "rep").select("cluster", "rep", "x", "within", "copies"), bucket)
    one = session.materialize(members.join(degrees, "rep").select("cluster", "size", "sample_id", "rep", "degree", "up"), "degrees")
    loose = one.groupBy("cluster").agg((F.max("degree") < LOOSE * (F.max("size") - 1)).alias("loose"))
    medoids = connected_components(one.join(loose.where("loose"), "cluster").select("rep", "up"), "rep", "up")
    grouped = one.join(loose, "cluster").join(medoids, one["rep"] == medoids["node"], "left")
    grouped = grouped.withColumn("group_id", F.when(F.col("loose"), F.coalesce("component", "rep")).otherwise(F.col("cluster")))
    grouped = grouped.join(samples.select("sample_id", "dataset_name", "y"), "sample_id")
    grouped = session.materialize(grouped.select("cluster", "group_id", "loose", "sample_id", "degree", "dataset_name", "y"), "groups")
    first = Window.partitionBy("group_id").orderBy(F.col("degree").desc(), "sample_id")
    best = grouped.withColumn("place", F.row_number().over(first)).where(F.col("place") <= typical)
    best = best.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "sample_id"))), lambda s: s["sample_id"]).alias("typical"))
    agree = grouped.where("y >= 0").groupBy("group_id", "y").agg(F.count("*").alias("n")).groupBy("group_id").agg((F.max("n") / F.sum("n")).alias("agreement"))
    sizes = grouped.groupBy("group_id").agg(F.min("cluster").alias("cluster"), F.min("dataset_name").alias("dataset_name"), F.count("*").alias("size"), F.max("loose").alias("loose"))
    return sizes.join(best, "group_id").join(agree, "group_id", "left").select("cluster", "group_id", "dataset_name", "size", "loose", "typical", "agreement")
