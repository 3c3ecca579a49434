"""Experiments from the command line: datasets by algorithms by seeds, resumed, summarised and written.

    python -m sphaera --data FOLDER --out FOLDER [--datasets A,B] [--algorithms x,y] [--seeds 1,2,3] [--settings 2]

``--data`` holds dataset.parquet and dataset_catalog.parquet. Runs are appended to OUT/runs and their labels to
OUT/labels; a second call makes only the runs that have no row yet, failed ones included in what is done. OUT/summary
and OUT/best are CSV, OUT/config.json tells the choice. ``--summaries`` makes no runs.
"""

from __future__ import annotations

import argparse
import pathlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera import session
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import grids, harness, metrics, scaling
from sphaera.sources import files


def chosen(text: str | None, known: list[str], what: str) -> list[str]:
    """The names of a comma list, all known ones without one; raises for unknown and repeated names."""
    if not text:
        return known
    names = [n.strip() for n in text.split(",") if n.strip()]
    unknown = [n for n in names if n not in known]
    if unknown or len(set(names)) != len(names):
        raise ValueError(f"{what}: unknown {unknown}" if unknown else f"{what} must differ")
    return names


def run(spark: SparkSession, data: str, out: str, datasets: list[str], algorithms: list[str], seeds: list[int], settings: int | None = None) -> None:
    """Make the pending runs; ``settings`` bounds how many of a default grid are run."""
    catalog, rows = session.tables(spark, data, "dataset_catalog"), session.tables(spark, data, "dataset")
    classes = {r.dataset_name: r.n_classes for r in catalog.where(F.col("dataset_name").isin(datasets)).groupBy("dataset_name").agg(F.max("n_classes").alias("n_classes")).collect()}
    for name in datasets:
        s = session.materialize(scaling.min_max(scaling.dataset_samples(rows, catalog, name).where("y >= 0")), "scaled")
        shape = scaling.validate(s, least_classes=2)
        k = classes[name] or shape["n_classes"]
        for algorithm in algorithms:
            grid = grids.default_grid(algorithm, shape["n_samples"], shape["max_width"])
            plan = harness.plan_runs(spark, algorithm, name, grid[:settings], seeds)
            harness.run_grid(s, k, plan, f"{out}/runs", labels_path=f"{out}/labels")


def summaries(spark: SparkSession, out: str, seeds: int) -> tuple[DataFrame, DataFrame]:
    """Write and return the summary of each setting and the best setting of each dataset and algorithm."""
    done = spark.read.schema(harness.SCHEMA).parquet(f"{out}/runs")
    by = ["dataset", "algorithm", "params"]
    summary = session.materialize(harness.summarise(done, by), "summary")
    best = harness.best_setting(summary, ["dataset", "algorithm"], ["params"], seeds)
    files.write_csv(summary, f"{out}/summary", summary.columns)
    files.write_csv(best, f"{out}/best", best.columns)
    return summary, best


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="sphaera", description="Run clusterers over datasets and seeds.")
    p.add_argument("--data", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--datasets")
    p.add_argument("--algorithms")
    p.add_argument("--seeds", default=",".join(map(str, grids.SEEDS)))
    p.add_argument("--settings", type=int, help="run no more settings of each grid than this")
    p.add_argument("--summaries", action="store_true", help="summarise only")
    a = p.parse_args(arguments)
    own = spark is None
    spark = spark or session.build_session()
    session.ship_package(spark)
    known = sorted(r.dataset_name for r in session.tables(spark, a.data, "dataset_catalog").select("dataset_name").where("dataset_name is not null").distinct().collect())
    seeds = [int(s) for s in a.seeds.split(",")]
    datasets, algorithms = chosen(a.datasets, known, "datasets"), chosen(a.algorithms, list(CLUSTERERS), "algorithms")
    if "://" not in a.out:
        pathlib.Path(a.out).mkdir(parents=True, exist_ok=True)
        files.write_json(f"{a.out}/config.json", {"datasets": datasets, "algorithms": algorithms, "seeds": seeds, "settings": a.settings, "metrics": list(metrics.NAMES)})
    out = a.out if "://" in a.out else f"file://{pathlib.Path(a.out).resolve()}"
    if not a.summaries:
        run(spark, a.data, out, datasets, algorithms, seeds, a.settings)
    _, best = summaries(spark, out, len(seeds))
    best.select("dataset", "algorithm", "params", F.round("acc_mean", 4).alias("acc"), F.round("nmi_mean", 4).alias("nmi")).orderBy("dataset", "algorithm").show(100, False)
    if own:
        session.drop_scratch(spark)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
