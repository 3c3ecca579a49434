"""Connected components of sample-scale graphs, and successors in ordered groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are linked to the least node of the neighbourhood.

    The least neighbour is a map-side aggregate, so a hub of any degree is no task of its own; the join back on
    the hub is one that adaptive execution can split.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionAll(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return moved.where("a <> b").select("a", "b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node; nodes without an edge to another node are absent.

    Alternating stars; each round is written to the shared folder, so lineage stays short and a lost executor
    costs no earlier round. Null ends and loops are skipped; repeated edges count once.
    """
    spark = edges.sparkSession
    kept = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    path = session.scratch_path(spark, "components")
    kept.write.parquet(path)
    state = None
    for _ in range(max_rounds):
        current = spark.read.schema("a long, b long").parquet(path)
        after = session.scratch_path(spark, "components")
        _star(_star(current, True), False).write.parquet(after)
        session.delete_path(spark, path)
        path = after
        result = spark.read.schema("a long, b long").parquet(path)
        row = result.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(row) == state or row[0] == 0:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    result = spark.read.schema("a long, b long").parquet(path)
    members = result.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return members.unionAll(result.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Successors within a sorted partition; its first and last row are told as boundaries."""
    import numpy as np

    before: tuple[int, int] | None = None
    first: tuple[int, int] | None = None

    def rows(g, a, b, kind) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(kind, pa.int32())], names=["g", "a", "b", "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if before is None:
            first = (int(g[0]), int(a[0]))
        else:
            g, a = np.concatenate([[before[0]], g]), np.concatenate([[before[1]], a])
        same = g[1:] == g[:-1]
        yield rows(g[:-1][same], a[:-1][same], a[1:][same], np.zeros(int(same.sum()), np.int32))
        before = (int(g[-1]), int(a[-1]))
    if before is not None and first is not None:
        yield rows([first[0], before[0]], [first[1], before[1]], [None, None], [1, 2])


def successors(members: DataFrame, group: str, item: str) -> DataFrame:
    """(g, a, b): for each item its next larger one in the group, for all but the last.

    Sorted by range over (group, item), so a group that holds most rows spreads over many tasks; only the first
    and last row of each range meet in a window.
    """
    ordered = session.materialize(members.select(F.col(group).cast("long").alias("g"), F.col(item).cast("long").alias("a")), "members")
    told = ordered.repartitionByRange("g", "a").sortWithinPartitions("g", "a").mapInArrow(_neighbours, "g long, a long, b long, kind int")
    told = session.materialize(told, "successors")
    edge = told.where("kind > 0")
    across = edge.withColumn("b", F.lead("a").over(Window.partitionBy("g").orderBy("a", "kind"))).where("kind = 2 and b is not null")
    return told.where("kind = 0").unionByName(across).select("g", "a", "b")
