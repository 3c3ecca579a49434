"""Usable samples, distinct vectors and NumPy helpers of the vector operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_samples(dataset: DataFrame, catalog: DataFrame) -> DataFrame:
    """(sample_id, dataset_name, x, y, within): one row a sample with ``n_features`` finite entries.

    Of several usable rows of one sample the one loaded last counts. Rows with a null id or name, and datasets
    without a width or ``similar_within``, are left out.
    """
    known = (
        catalog.where("dataset_name is not null and n_features is not null and similar_within is not null")
        .groupBy("dataset_name")
        .agg(F.max(F.struct("registered_at", "n_features", "similar_within")).alias("c"))
        .select("dataset_name", "c.n_features", F.col("c.similar_within").alias("within"))
    )
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = (
        dataset.where("sample_id is not null and dataset_name is not null and x is not null")
        .select("sample_id", "dataset_name", "x", "y", "loaded_at")
        .join(known, "dataset_name")
        .where((F.size("x") == F.col("n_features")) & finite)
    )
    when = F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0)))
    last = F.max(F.struct(when.alias("w"), "dataset_name", "x", "y", "within")).alias("m")
    return rows.groupBy("sample_id").agg(last).select("sample_id", "m.dataset_name", "m.x", "m.y", "m.within")


def distinct_vectors(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors: rep, dataset_name, x, within, copies) and (members: sample_id, rep).

    Equal vectors of a dataset are one vector, named after its smallest sample; counting them is a map-side
    aggregate, so any number of copies may be equal.
    """
    vectors = samples.groupBy("dataset_name", "x").agg(F.min("sample_id").alias("rep"), F.count("*").alias("copies"), F.first("within").alias("within"))
    several = vectors.where("copies > 1").select("dataset_name", "x", "rep")
    members = samples.select("sample_id", "dataset_name", "x").join(several, ["dataset_name", "x"], "left").select("sample_id", F.coalesce("rep", "sample_id").alias("rep"))
    return vectors.select("rep", "dataset_name", "x", "within", "copies"), members


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of a partition sorted by its first ``keys`` columns, each as one table."""
    held: list[pa.RecordBatch] = []
    name = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            v = c.to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for lo, hi in zip(starts[:-1], starts[1:]):
            this = tuple(c[lo].as_py() for c in columns)
            if held and this != name:
                yield pa.Table.from_batches(held)
                held = []
            name = this
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def near(a: np.ndarray, b: np.ndarray, within: float) -> np.ndarray:
    """Which pairs of rows of ``a`` and ``b`` are at most ``within`` apart; close calls are decided exactly."""
    middle = a.mean(0) if len(a) else 0.0
    p, q = a - middle, b - middle
    pp, qq = (p * p).sum(1), (q * q).sum(1)
    d2 = pp[:, None] + qq[None, :] - 2.0 * (p @ q.T)
    r2 = within * within
    unsure = np.abs(d2 - r2) <= 1e-9 * (r2 + pp.max(initial=0.0) + qq.max(initial=0.0))
    out = d2 <= r2
    if unsure.any():
        i, j = np.nonzero(unsure)
        for lo in range(0, len(i), 1 << 18):
            s = slice(lo, lo + (1 << 18))
            out[i[s], j[s]] = exact(a[i[s]], b[j[s]]) <= within
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed entry by entry in order, so equal for equal pairs everywhere."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        diff = a[:, k] - b[:, k]
        total += diff * diff
    return np.sqrt(total)


MapArrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
