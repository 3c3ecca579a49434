"""Ordered-column operators: local spreads, prefix curves, ranks, splits and percentiles.

Ties are ordered by id. A column of at most ``RANGE`` values is one window partition. A longer one is sorted by
ranges, its values numbered across them, and cut into blocks of ``RANGE`` with the neighbours each block needs, so no
task holds a whole column. Order statistics of long columns are found by narrowing a bracket. Null values take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session

EPS = 2.220446049250313e-16
RANGE = 1_000_000


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the range and the place of each row among those of its column in a sorted range."""
    import numpy as np
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    column, place = None, 0
    for batch in batches:
        f = batch.column(1).to_numpy()
        at = np.empty(len(f), np.int64)
        starts = np.concatenate([[0], np.nonzero(np.diff(f))[0] + 1, [len(f)]]) if len(f) else np.zeros(1, int)
        for lo, hi in zip(starts[:-1], starts[1:]):
            first = place if f[lo] == column else 0
            at[lo:hi] = np.arange(first, first + hi - lo)
            column, place = f[lo], first + hi - lo
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(f), part, np.int32)), pa.array(at)], names=["sample_id", "f", "v", "part", "place"])


def _ranges(long: DataFrame) -> DataFrame:
    """(sample_id, f, v, part, place, before, sum_before): values by ranges and what the ranges before them hold."""
    order = ["f", "v", "sample_id"]
    rows = long.select(F.col("sample_id").cast("long").alias("sample_id"), F.col("f").cast("int").alias("f"), F.col("v").cast("double").alias("v"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "sample_id long, f int, v double, part int, place long")
    rows = session.materialize(rows, "ranges")
    sizes = rows.groupBy("f", "part").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    earlier = Window.partitionBy("f").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("f", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("sum_before"))
    return rows.join(offset, ["f", "part"])


def _is_long(long: DataFrame, limit: int) -> bool:
    return not long.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") > limit).isEmpty()


def order_statistic(rows: DataFrame, value: str, place: int, limit: int = RANGE) -> float | None:
    """The value at a 0-based place of the ascending order; None for an empty table."""
    v = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    lo = hi = None
    while True:
        inside = v if lo is None else v.where((F.col("v") >= lo) & (F.col("v") <= hi))
        below = v.where(F.col("v") < lo).count() if lo is not None else 0
        n = inside.count()
        if not n:
            return None
        if lo is not None and lo == hi:
            return lo
        if n <= limit:
            at = F.row_number().over(Window.orderBy("v"))
            row = inside.withColumn("r", at).where(F.col("r") == place - below + 1).first()
            return row.v if row else None
        share = (place - below + 0.5) / n
        q = inside.approxQuantile("v", [max(0.0, share - 0.003), min(1.0, share + 0.003)], 0.001)
        new = (q[0], q[1])
        if v.where(F.col("v") < new[0]).count() > place:
            new = (inside.agg(F.min("v")).first()[0], new[0])
        elif v.where(F.col("v") <= new[1]).count() <= place:
            new = (new[1], inside.agg(F.max("v")).first()[0])
        if new == (lo, hi):
            return order_statistic(inside, "v", place - below, n)
        lo, hi = new


def local_spread(long: DataFrame, k: int, limit: int = RANGE) -> DataFrame:
    """(sample_id, f, v, left, right): how far the mean of the k values before and after lies, at least EPS.

    A value without predecessors takes the right spread, one without successors the left.
    """
    long = long.where("v is not null")
    if _is_long(long, limit):
        ranked = _ranges(long).withColumn("rank", F.col("before") + F.col("place"))
        own, off = F.floor(F.col("rank") / limit), F.pmod("rank", F.lit(limit))
        blocks = F.array_compact(F.array(own, F.when((off < k) & (own > 0), own - 1), F.when(off >= limit - k, own + 1)))
        halo = ranked.select("sample_id", "f", "v", "rank", own.alias("own"), F.explode(blocks).alias("block"))
        by = Window.partitionBy("f", "block").orderBy("rank")
    else:
        halo = long.select("sample_id", "f", "v", F.lit(0).alias("own"), F.lit(0).alias("block"))
        by = Window.partitionBy("f").orderBy("v", "sample_id")
    before = F.col("v") - F.avg("v").over(by.rowsBetween(-k, -1))
    after = F.avg("v").over(by.rowsBetween(1, k)) - F.col("v")
    spread = halo.select("sample_id", "f", "v", "own", "block", before.alias("l"), after.alias("r")).where("own = block")
    at_least = lambda a, b: F.greatest(F.coalesce(a, b, F.lit(0.0)), F.lit(EPS))
    return spread.select("sample_id", "f", "v", at_least(F.col("l"), F.col("r")).alias("left"), at_least(F.col("r"), F.col("l")).alias("right"))


def prefix_sum(long: DataFrame, limit: int = RANGE) -> DataFrame:
    """(sample_id, f, v, prefix): running sum of each ordered column."""
    long = long.where("v is not null")
    if _is_long(long, limit):
        by = Window.partitionBy("f", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        return _ranges(long).select("sample_id", "f", "v", (F.col("sum_before") + F.sum("v").over(by)).alias("prefix"))
    by = Window.partitionBy("f").orderBy("v", "sample_id")
    return long.withColumn("prefix", F.sum("v").over(by.rowsBetween(Window.unboundedPreceding, 0)))


def rank_norm(scores: DataFrame, key: str, score: str) -> DataFrame:
    """Adds ``rank_score``: 1 for the greatest score down to 0 for the least; a single row gets 1."""
    by = Window.orderBy(F.col(score).desc(), key)
    n = F.count("*").over(Window.partitionBy())
    return scores.withColumn("rank_score", F.when(n > 1, 1 - (F.row_number().over(by) - 1) / (n - 1)).otherwise(F.lit(1.0)))


def softmax_entropy(rows: DataFrame, group: str, log_weight: str) -> DataFrame:
    """(group, entropy): Shannon entropy of exp(log_weight), normalised within each group."""
    most = rows.groupBy(group).agg(F.max(log_weight).alias("m"))
    z = rows.join(most, group).withColumn("e", F.exp(F.col(log_weight) - F.col("m")))
    s = z.groupBy(group).agg(F.sum("e").alias("s"), F.sum(F.col("e") * (F.col(log_weight) - F.col("m"))).alias("t"))
    return s.select(group, (F.ln("s") - F.col("t") / F.col("s")).alias("entropy"))


def leave_one_out(intensities: DataFrame) -> DataFrame:
    """(f, score): entropy of the whole feature set less that of the set without f.

    intensities: (sample_id, f, intensity). What is left without f is the sample's total less its own term.
    """
    total = intensities.groupBy("sample_id").agg(F.sum("intensity").alias("total"))
    whole = softmax_entropy(total.withColumn("all", F.lit(1)), "all", "total").select(F.col("entropy").alias("whole"))
    less = intensities.join(total, "sample_id").select("f", (F.col("total") - F.col("intensity")).alias("rest"))
    return softmax_entropy(less, "f", "rest").crossJoin(F.broadcast(whole)).select("f", (F.col("whole") - F.col("entropy")).alias("score"))


def prefix_entropy(intensities: DataFrame, order: DataFrame) -> DataFrame:
    """(rank, entropy, loss): entropy of the first features in the given order (f, rank), and its relative loss."""
    by = Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    grown = intensities.join(order, "f").withColumn("total", F.sum("intensity").over(by))
    curve = softmax_entropy(grown, "rank", "total")
    last = curve.agg(F.max_by("entropy", "rank").alias("last"))
    loss = F.abs(F.col("entropy") - F.col("last")) / F.greatest(F.abs("last"), F.lit(EPS))
    return curve.crossJoin(F.broadcast(last)).select("rank", "entropy", loss.alias("loss"))


def first_feasible(curve: DataFrame, limit: float) -> DataFrame:
    """One row: the least rank whose loss is at most ``limit``, else the last rank."""
    return curve.agg(F.coalesce(F.min(F.when(F.col("loss") <= limit, F.col("rank"))), F.max("rank")).alias("rank"))


def half_split(rows: DataFrame, ball: str, score: str, key: str) -> DataFrame:
    """Adds ``half``: 0 for the lower floor(n / 2) scores of a ball, 1 for the rest."""
    by = Window.partitionBy(ball).orderBy(score, key)
    n = F.count("*").over(Window.partitionBy(ball))
    return rows.withColumn("half", F.when(F.row_number().over(by) <= F.floor(n / 2), 0).otherwise(1))


def median_split(rows: DataFrame, ball: str, score: str) -> DataFrame:
    """Adds ``half``: 0 for scores up to the ball's median, 1 beyond."""
    middle = rows.groupBy(ball).agg(F.median(score).alias("middle"))
    return rows.join(middle, ball).withColumn("half", F.when(F.col(score) <= F.col("middle"), 0).otherwise(1)).drop("middle")


def core_balls(balls: DataFrame, radius: str, share: float) -> DataFrame:
    """Balls whose radius is at most the int(m * share)-th smallest (at least the first)."""
    bar = order_statistic(balls, radius, max(int(balls.count() * share), 1) - 1)
    return balls.where(F.col(radius) <= F.lit(bar))


def border_filter(values: DataFrame, value: str, share: float) -> DataFrame:
    """Rows above the value at 0-based place int(n * share); ties with it are border too."""
    bar = order_statistic(values, value, int(values.count() * share))
    return values.where(F.col(value) > F.lit(bar))


def percentiles(rows: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row: exact percentiles by linear interpolation."""
    return rows.agg(*[F.percentile(value, s).alias(f"p{round(s * 100)}") for s in shares])
