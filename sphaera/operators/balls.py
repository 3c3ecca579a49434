"""Granular balls: statistics from memberships, and generators that split until a rule holds.

A ball table is (sample_id, ball). Statistics are aggregates over the members. Generators run in two phases.
While a ball has more than ``LOCAL`` rows it is split by Spark jobs, all such balls at once: mean, farthest member
from it, farthest member from that one, and each row to the nearer of the two; this two-step rule takes the place
of the farthest of all pairs, which no cluster could enumerate at that size. Balls that fit are finished in one
task each by a NumPy kernel that applies the generator's own rules to the end. Paths name the balls, so the order
of balls does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sphaera import session
from sphaera.functions.vectors import distance

LOCAL = 8192
#: Balls of which a table of all pairs is held.
PAIRED = 6_000


def centers(members: DataFrame) -> DataFrame:
    """(ball, size, center) of (sample_id, ball, features)."""
    mean = members.select("ball", F.posexplode("features").alias("f", "v")).groupBy("ball", "f").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("f", "m")))
    return mean.groupBy("ball").agg(F.max("n").alias("size"), F.transform(ordered, lambda s: s["m"]).alias("center"))


def ball_stats(members: DataFrame) -> DataFrame:
    """(ball, size, center, avg_radius, max_radius, sum_radius, num_in_ball, std_radius)."""
    mid = centers(members)
    d = members.join(mid, "ball").withColumn("d", distance(F.col("features"), F.col("center")))
    r = d.groupBy("ball").agg(F.avg("d").alias("avg_radius"), F.max("d").alias("max_radius"), F.sum("d").alias("sum_radius"), F.stddev_pop("d").alias("std_radius"))
    inside = d.select("ball", "d").join(r.select("ball", "avg_radius"), "ball").groupBy("ball").agg(F.count_if(F.col("d") <= F.col("avg_radius")).alias("num_in_ball"))
    return mid.join(r, "ball").join(inside, "ball").select("ball", "size", "center", "avg_radius", "max_radius", "sum_radius", "num_in_ball", "std_radius")


def with_density(stats: DataFrame) -> DataFrame:
    """Adds the densities of the families: size/sum, size/(max^2 avg), spread quality, share of inner mass."""
    peak = F.col("max_radius") * F.col("max_radius") * F.col("avg_radius")
    return stats.withColumns(
        {
            "mean_density": F.when(F.col("sum_radius") > 0, F.col("size") / F.col("sum_radius")).otherwise(F.col("size").cast("double")),
            "peak_density": F.when(peak > 0, F.col("size") / peak).otherwise(F.lit(0.0)),
            "quality": F.when(F.col("size") <= 2, F.lit(float("inf"))).otherwise(F.col("avg_radius") * (1 + F.col("std_radius") / (F.col("avg_radius") + 1e-10))),
        }
    )


def pseudo_purity(members: DataFrame, label: str) -> DataFrame:
    """(ball, purity): share of the most frequent label of each ball."""
    n = members.groupBy("ball", label).agg(F.count("*").alias("n"))
    return n.groupBy("ball").agg((F.max("n") / F.sum("n")).alias("purity"))


def farthest_two(members: DataFrame) -> DataFrame:
    """(ball, p, q): the member farthest from the mean and the one farthest from that; ties to the smaller id."""
    far = lambda df, to: df.withColumn("d", distance(F.col("features"), F.col(to))).groupBy("ball")
    pick = F.max_by(F.struct("sample_id", "features"), F.struct("d", -F.col("sample_id")))
    first = far(members.join(centers(members).select("ball", "center"), "ball"), "center").agg(pick.alias("p"))
    second = far(members.join(first.select("ball", F.col("p.features").alias("at")), "ball"), "at").agg(pick.alias("q"))
    return first.join(second, "ball")


def _coarse(samples: DataFrame, local: int) -> tuple[DataFrame, DataFrame | None]:
    """(members, equal): balls of at most ``local`` rows, and the names of larger ones whose rows are all equal."""
    members = samples.select("sample_id", "features", F.lit("").alias("ball"))
    while True:
        big = members.groupBy("ball").agg(F.count("*").alias("n")).where(F.col("n") > local)
        ends = session.materialize(farthest_two(members.join(big, "ball", "left_semi")), "ends")
        if ends.isEmpty():
            return members, None
        apart = ends.where("p.features <> q.features")
        if apart.isEmpty():
            return members, ends.select("ball")
        moved = members.join(apart, "ball", "left")
        side = F.when(distance(F.col("features"), F.col("p.features")) <= distance(F.col("features"), F.col("q.features")), "0").otherwise("1")
        members = session.materialize(moved.select("sample_id", "features", F.when(F.col("p").isNotNull(), F.concat("ball", side)).otherwise(F.col("ball")).alias("ball")), "members")


Kernel = Callable[[np.ndarray], np.ndarray]


def generate(samples: DataFrame, kernel: Kernel, local: int = LOCAL) -> DataFrame:
    """(sample_id, features, ball): balls by ``kernel``, which maps the rows of one ball to ball numbers."""

    rows = samples.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("features").cast("array<double>").alias("features"))
    members, equal = _coarse(rows, local)
    return refine(members, kernel, equal)


def refine(members: DataFrame, kernel: Kernel, equal: DataFrame | None = None) -> DataFrame:
    """The balls that ``kernel`` makes of each ball; they fit in a task, as ``generate`` leaves them.

    The balls named in ``equal`` hold equal rows only, however many, which no kernel parts: they stay as they are and are no task.
    """

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("sample_id")
        x = table.column("features").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        names = [f"{key[0].as_py()}/{int(b):06d}" for b in kernel(x)]
        return table.set_column(table.schema.get_field_index("ball"), "ball", pa.array(names))

    parted = members if equal is None else members.join(equal, "ball", "left_anti")
    done = parted.groupBy("ball").applyInArrow(finish, "sample_id long, features array<double>, ball string")
    if equal is not None:
        whole = members.join(equal, "ball", "left_semi")
        done = done.unionByName(whole.select("sample_id", "features", F.concat("ball", F.lit("/000000")).alias("ball")))
    return session.materialize(done, "balls")


def collect_balls(stats: DataFrame, limit: int | None = PAIRED) -> dict[str, np.ndarray]:
    """Ball statistics as arrays in the order of the balls; refuses more than ``limit`` balls, whose distances would take 0.3 GB.

    None stands for callers that hold no distances of all pairs.
    """
    if limit is not None and (m := stats.count()) > limit:
        raise ValueError(f"{m} balls are more than the {limit} a ball graph is built for; ask for larger balls")
    rows = stats.orderBy("ball").toPandas()
    out = {c: rows[c].to_numpy() for c in rows.columns if c != "center"}
    out["center"] = np.stack(rows["center"].to_list()) if len(rows) else np.empty((0, 0))
    return out


def scatter(members: DataFrame, names: np.ndarray, labels: np.ndarray) -> DataFrame:
    """(sample_id, label): the label of each sample's ball."""
    spark = members.sparkSession
    table = pa.table({"ball": pa.array([str(b) for b in names]), "label": pa.array(np.asarray(labels, np.int64).astype(np.int32))})
    return members.select("sample_id", "ball").join(spark.createDataFrame(table), "ball").select("sample_id", "label")


def noise_balls(stats: DataFrame, share: float = 0.2) -> DataFrame:
    """Adds ``noise``: fewer than 2 rows, or size over radius below ``share`` of its mean over all balls."""
    density = F.when(F.col("max_radius") > 0, F.col("size") / F.col("max_radius"))
    mean = stats.agg(F.avg(density).alias("mean"))
    return stats.crossJoin(F.broadcast(mean)).withColumn("noise", (F.col("size") < 2) | F.coalesce(density < share * F.col("mean"), F.lit(False))).drop("mean")


def stop_split(members: DataFrame, label: str, theta: float) -> DataFrame:
    """(ball, size, purity, stops): whether a ball is kept: fewer than 2 rows, or pure enough and fewer than 8."""
    size = members.groupBy("ball").agg(F.count("*").alias("size"))
    return size.join(pseudo_purity(members, label), "ball").withColumn("stops", (F.col("size") < 2) | ((F.col("purity") >= theta) & (F.col("size") < 8)))


def cover_radius(graph: DataFrame) -> DataFrame:
    """(anchor_id, radius, covered): weighted mean distance and number of the samples tied to each anchor."""
    return graph.groupBy("anchor_id").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("radius"), F.count("*").alias("covered"))


def label_confidence(near: DataFrame) -> DataFrame:
    """(a, confidence): (second - first) / (second + first) of the two smallest centre distances of each sample."""
    two = near.where("rank <= 2").groupBy("a").agg(F.min("d").alias("first"), F.max("d").alias("second"))
    total = F.col("first") + F.col("second")
    return two.select("a", F.when(total > 0, (F.col("second") - F.col("first")) / total).otherwise(F.lit(0.0)).alias("confidence"))
