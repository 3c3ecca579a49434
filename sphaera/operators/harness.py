"""Experiments: parameter grids over seeds, run tables that resume, summaries and best settings.

A run table has one row a run: algorithm, dataset, seed, params (a JSON text with sorted keys), status, the ten
metrics, runtime and error. Failed runs are rows too. Summaries are aggregates over such a table; only settings
whose every seed succeeded with a finite accuracy are candidates for the best.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import traceback
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.clusterers.ball_clusterers import shared_starts
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import metrics
from sphaera.sources import files

KEY = ["algorithm", "dataset", "seed", "params"]
SCHEMA = "algorithm string, dataset string, seed int, params string, status string, " + ", ".join(f"{m} double" for m in metrics.NAMES) + ", runtime_seconds double, error_type string, error_message string, error_trace string"


# Parameter values.


def counts_and_ratios(counts: Iterable[int], ratios: Iterable[float], total: int) -> tuple[int, ...]:
    """Counts, and ratios of ``total`` rounded up, within 1..total, each once, in order."""
    values = {c for c in counts if 1 <= c <= total} | {min(total, max(1, math.ceil(r * total - 1e-9))) for r in ratios}
    return tuple(sorted(values))


def floored_ratio(ratio: float, total: int) -> int:
    """A share of ``total`` in (0, 1], rounded up to a count."""
    if not 0 < ratio <= 1:
        raise ValueError("a ratio must lie in (0, 1]")
    return max(1, math.ceil(ratio * total - 1e-9))


def neighbour_count(value: int | float, n: int) -> int:
    """A count as it is, a ratio of the n - 1 other samples rounded up; within 1..n-1."""
    if isinstance(value, bool) or not isinstance(value, int | float) or value <= 0:
        raise ValueError("neighbours must be a positive count or ratio")
    wanted = value if isinstance(value, int) else math.ceil((n - 1) * value - 1e-9)
    return max(1, min(int(wanted), max(1, n - 1)))


def tag(value: int | float) -> str:
    """``count:5`` or ``ratio:0.25``."""
    return f"count:{value}" if isinstance(value, int) else f"ratio:{value:.12g}"


def untag(text: str) -> int | float:
    kind, _, value = text.partition(":")
    if kind not in ("count", "ratio") or not value:
        raise ValueError(f"no neighbour tag: {text}")
    return int(value) if kind == "count" else float(value)


def grid(values: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """All combinations, each once, in the order of the values."""
    unique = [list(dict.fromkeys(v)) for v in values.values()]
    return [dict(zip(values, combination)) for combination in itertools.product(*unique)]


def key_text(params: Mapping[str, Any]) -> str:
    return json.dumps(params, sort_keys=True)


# Runs.


def plan_runs(spark: SparkSession, algorithm: str, dataset: str, settings: list[dict[str, Any]], seeds: Sequence[int]) -> DataFrame:
    """The runs of a grid, as rows of the key."""
    if algorithm not in CLUSTERERS:
        raise ValueError(f"unknown algorithm {algorithm}")
    if len(set(seeds)) != len(seeds):
        raise ValueError("seeds must differ")
    rows = [(algorithm, dataset, int(s), key_text(p)) for s in seeds for p in settings]
    return spark.createDataFrame(rows, "algorithm string, dataset string, seed int, params string")


def pending(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Planned runs without a row yet; failed ones count as done."""
    return plan.join(runs.select(*KEY).distinct(), KEY, "left_anti")


def run_grid(samples: DataFrame, k: int, plan: DataFrame, path: str, average: str = "geometric", labels_path: str | None = None) -> DataFrame:
    """Make the pending runs of ``plan`` on ``samples`` and append each to the run table at ``path``.

    Labels are appended to the table at ``labels_path``, where given, under the run's key.
    """
    spark = samples.sparkSession
    done = spark.read.schema(SCHEMA).parquet(path) if session.path_exists(spark, path) else spark.createDataFrame([], SCHEMA)
    with shared_starts():
        for run in pending(plan, done).orderBy(*KEY).collect():
            began = time.time()
            row: dict[str, Any] = run.asDict()
            try:
                labels = session.materialize(CLUSTERERS[run.algorithm].run(samples, k, seed=run.seed, **json.loads(run.params)), "labels")
                row |= {"runtime_seconds": time.time() - began, "status": "success"}
                if labels_path:
                    files.append_labels(labels, labels_path, **{c: run[c] for c in KEY})
                row |= metrics.evaluate(samples.select("sample_id", "y").join(labels, "sample_id"), average).first().asDict()
            except Exception as error:  # a failed run is a result
                row |= {"runtime_seconds": time.time() - began, "status": "failed", "error_type": type(error).__name__, "error_message": str(error)[:500], "error_trace": traceback.format_exc()[-4000:]}
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            spark.createDataFrame([tuple(row.get(n) for n in names)], SCHEMA).write.mode("append").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


# Summaries.


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def summarise(runs: DataFrame, by: Sequence[str], names: Sequence[str] = metrics.NAMES) -> DataFrame:
    """One row a setting: successful runs, mean and population deviation of each metric, runtimes."""
    good = F.col("status") == "success"
    of = lambda c: F.when(good & _finite(c), F.col(c))
    columns = [F.count_if(good & _finite("acc")).alias("success_runs")]
    for m in names:
        columns += [F.avg(of(m)).alias(f"{m}_mean"), F.stddev_pop(of(m)).alias(f"{m}_std")]
    columns += [F.avg(of("runtime_seconds")).alias("runtime_seconds_mean"), F.sum(of("runtime_seconds")).alias("runtime_seconds_sum")]
    return runs.groupBy(*by).agg(*columns)


def exact_spread(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean and population deviation of a metric, to the millionth, from exact sums of its millionths."""
    v = F.round(F.col(metric) * 1_000_000).cast("long")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    sums = runs.select(by, v.alias("v")).groupBy(by).agg(F.sum("v").cast("double").alias("a"), F.sum((F.col("v") * F.col("v")).cast("decimal(38,0)")).cast("double").alias("b"), F.count("*").cast("double").alias("n"))
    millionth = lambda x: F.floor(x + 0.5).cast("double") / 1_000_000
    return sums.select(by, millionth(a / n).alias(f"{metric}_mean"), millionth(F.sqrt(F.greatest(b / n - (a / n) * (a / n), F.lit(0.0)))).alias(f"{metric}_std"))


def best_setting(summary: DataFrame, group: Sequence[str], params: Sequence[str], seeds: int) -> DataFrame:
    """The best candidate of each group: accuracy, NMI, F-measure, then parameters in order.

    Wall-clock time decides nothing, so a repeated experiment gives the same row.
    """
    order = [F.col(f"{m}_mean").desc_nulls_last() for m in ("acc", "nmi", "f_measure")] + [F.col(p).asc_nulls_first() for p in params]
    ready = summary.where((F.col("success_runs") == seeds) & _finite("acc_mean"))
    return ready.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("place = 1").drop("place")


def feature_count_range(runs: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.min(column).alias("least"), F.max(column).alias("most"))


def latest_runs(runs: DataFrame, key: str, when: str) -> DataFrame:
    """One row a run id: of repeated rows the one logged last."""
    columns = [c for c in runs.columns if c not in (key, when)]
    return runs.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(when)).alias("r")).select(key, "r.*")


def tidy_name(name: Column) -> Column:
    """A dataset's name without outer blanks and with one spelling of letters and separators."""
    bare = F.lower(F.regexp_replace(F.trim(name), r"[\s\-]+", "_"))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1000))
