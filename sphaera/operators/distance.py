"""Distance joins: nearest neighbours, overlaps and the graphs built from them.

The nearest-neighbour joins take the queries in Arrow batches against blocks of the corpus. The corpus is written once to the
shared folder in files of at most ``BLOCK_BYTES`` of vectors; each task of the queries reads one block after the other
and keeps the best k, so neither side is shuffled, nothing but file names passes through the driver, and what a task holds does
not grow with the corpus. Distances are summed entry by entry; equal ones are ordered by id.

Rows with null ids or features are skipped; repeated ids count once each; empty sides give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.functions.vectors import distance

BLOCK_BYTES = 64 << 20
_KNN = "a long, b long, d double, rank int"
QUERY_ROWS = 16_384

Corpus = list[str]


def write_corpus(corpus: DataFrame) -> Corpus:
    """The files of the rows (sample_id, features, ...) of a corpus, each at most ``BLOCK_BYTES`` of vectors."""
    spark = corpus.sparkSession
    path = session.scratch_path(spark, "corpus")
    width = corpus.agg(F.max(F.size("features"))).first()[0] or 1
    corpus.write.option("maxRecordsPerFile", max(1, BLOCK_BYTES // (width * 8 + 8))).parquet(path)
    return [f"{path}/{name}" for name in sorted(session.names_in(spark, path)) if name.endswith(".parquet")]


def read_blocks(files: Corpus, columns: list[str]) -> Iterator[pa.Table]:
    """The blocks of a corpus in a task, in the order of their files."""
    for f in files:
        block = session.open_parquet(f).read(columns=columns)
        if block.num_rows:
            yield block


def rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of equal width as a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def block_nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, skip_same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, distance) of the k rows of a block nearest to each query, in that order."""
    middle = x.mean(0)
    centred = x - middle
    squares = (centred * centred).sum(1)
    found = []
    step = max(1, (1 << 22) // max(1, len(ids)))
    for lo in range(0, len(q_ids), step):
        part, part_ids = q[lo : lo + step], q_ids[lo : lo + step]
        p = part - middle
        pp = (p * p).sum(1)
        rough = pp[:, None] + squares[None, :] - 2.0 * (p @ centred.T)
        if skip_same:
            rough[part_ids[:, None] == ids[None, :]] = np.inf
        limit = np.full(len(part), np.inf)
        if len(ids) > k:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2e-9 * (pp + squares.max())
        i, j = np.nonzero((rough <= limit[:, None]) & (rough < np.inf))
        total = np.zeros(len(i))
        for c in range(x.shape[1]):
            diff = part[i, c] - x[j, c]
            total += diff * diff
        found.append((i + lo, ids[j], np.sqrt(total)))
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


def top(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row and their ranks."""
    order = np.lexsort((ids, d, i))
    i, ids, d = i[order], ids[order], d[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    top = rank < k
    return i[top], ids[top], d[top], rank[top] + 1


def _search(files: Corpus, k: int, skip_same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answered() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            q_ids, q = t.column(0).to_numpy(), rows_of(t.column(1))
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            rank = np.empty(0, np.int64)
            for block in read_blocks(files, ["sample_id", "features"]):
                found = block_nearest(q_ids, q, block.column(0).to_numpy(), rows_of(block.column(1)), k, skip_same)
                *best, rank = top(*(np.concatenate(c) for c in zip(best, found)), k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]]), pa.array(best[1]), pa.array(best[2]), pa.array(rank.astype(np.int32))], names=["a", "b", "d", "rank"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= QUERY_ROWS:
                yield from answered()
                held.clear()
        if held:
            yield from answered()

    return run


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, skip_same: bool = True) -> DataFrame:
    """(a, b, d, rank): the k rows of ``corpus`` nearest to each query; both (sample_id, features)."""
    known = lambda df: df.where("sample_id is not null and features is not null").select(F.col("sample_id").cast("long").alias("sample_id"), F.col("features").cast("array<double>").alias("features"))
    return known(queries).mapInArrow(_search(write_corpus(known(corpus)), k, skip_same), _KNN)


def knn(samples: DataFrame, k: int) -> DataFrame:
    """(a, b, d, rank): the k nearest other samples of each sample."""
    return knn_join(samples, samples, k)


def mutual_edges(neighbours: DataFrame) -> DataFrame:
    """(a, b, d): undirected pairs in which each is a neighbour of the other."""
    back = neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return neighbours.join(back, ["a", "b"], "left_semi").where("a < b").select("a", "b", "d")


def union_edges(neighbours: DataFrame) -> DataFrame:
    """(a, b): undirected pairs in which at least one is a neighbour of the other."""
    return neighbours.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def local_scale(neighbours: DataFrame) -> DataFrame:
    """(a, scale): distance of the farthest kept neighbour."""
    return neighbours.groupBy("a").agg(F.max("d").alias("scale"))


def reverse_density(neighbours: DataFrame) -> DataFrame:
    """(b, density): for each sample the sum over those that have it as neighbour of exp(-d^2 / scale^2)."""
    scaled = neighbours.join(local_scale(neighbours), "a")
    weight = F.when(F.col("scale") > 0, F.exp(-F.col("d") * F.col("d") / (F.col("scale") * F.col("scale")))).otherwise(F.lit(1.0))
    return scaled.groupBy("b").agg(F.sum(weight).alias("density"))


def link_threshold(neighbours: DataFrame) -> DataFrame:
    """One row: mean plus population deviation of all neighbour distances."""
    return neighbours.agg((F.avg("d") + F.stddev_pop("d")).alias("lambda"))


def shared_neighbours(neighbours: DataFrame) -> DataFrame:
    """(a, b, shared): how many neighbours two samples have in common, for pairs with any."""
    other = neighbours.select(F.col("a").alias("o"), "b")
    return neighbours.select("a", "b").join(other, "b").where("a < o").groupBy("a", F.col("o").alias("b")).agg(F.count("*").alias("shared"))


def two_hops(neighbours: DataFrame) -> DataFrame:
    """(a, b): neighbours and their neighbours, without the sample itself."""
    step = neighbours.select(F.col("a").alias("m"), F.col("b").alias("t"))
    far = neighbours.join(step, neighbours["b"] == step["m"]).select("a", F.col("t").alias("b"))
    return neighbours.select("a", "b").unionByName(far).where("a <> b").distinct()


def anchor_graph(samples: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """(sample_id, anchor_id, d, w): Gaussian weights of the k nearest anchors; sigma is the mean distance."""
    near = knn_join(samples, anchors, k, skip_same=False)
    sigma = near.agg(F.avg("d").alias("sigma"))
    w = F.when(F.col("sigma") > 0, F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma")))).otherwise(F.lit(1.0))
    w = F.greatest(w, F.lit(2.220446049250313e-16))
    return near.crossJoin(F.broadcast(sigma)).select(F.col("a").alias("sample_id"), F.col("b").alias("anchor_id"), "d", w.alias("w"))


def anchor_gram(graph: DataFrame) -> DataFrame:
    """(a, b, w): the anchors' graph B' D^-1 B, from the edges of each sample; k^2 rows a sample."""
    degree = graph.groupBy("sample_id").agg(F.sum("w").alias("degree"))
    left = graph.join(degree, "sample_id").select("sample_id", F.col("anchor_id").alias("a"), (F.col("w") / F.col("degree")).alias("wa"))
    right = graph.select("sample_id", F.col("anchor_id").alias("b"), F.col("w").alias("wb"))
    return left.join(right, "sample_id").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def overlaps(balls: DataFrame, slack: float = 0.0) -> DataFrame:
    """(a, b, d): pairs of balls (ball_id, center, radius) whose spheres meet."""
    a = balls.select(F.col("ball_id").alias("a"), F.col("center").alias("ca"), F.col("radius").alias("ra"))
    b = balls.select(F.col("ball_id").alias("b"), F.col("center").alias("cb"), F.col("radius").alias("rb"))
    d = distance(F.col("ca"), F.col("cb"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("d", d).where(F.col("d") <= F.col("ra") + F.col("rb") + slack).select("a", "b", "d")


def nearest_denser(points: DataFrame) -> DataFrame:
    """(ball_id, rank, delta, parent): for each ball the nearest one earlier in the order of density.

    points: (ball_id, center, density). The first ball gets the greatest delta and no parent. Meant for ball
    tables, which are far smaller than the samples.
    """
    ranked = points.withColumn("rank", F.row_number().over(Window.orderBy(F.col("density").desc(), "ball_id")))
    early = ranked.select(F.col("ball_id").alias("parent"), F.col("rank").alias("r"), F.col("center").alias("c"))
    pairs = ranked.join(early, F.col("r") < F.col("rank"), "left").withColumn("d", distance(F.col("center"), F.col("c")))
    best = pairs.groupBy("ball_id", "rank", "density").agg(F.min("d").alias("delta"), F.min_by("parent", F.struct("d", "r")).alias("parent"))
    top = best.agg(F.max("delta").alias("most"))
    return best.crossJoin(F.broadcast(top)).select("ball_id", "rank", "density", F.coalesce("delta", "most", F.lit(0.0)).alias("delta"), "parent")
