"""Queries of the experiment harness, the clusterers, the sources and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera import session
from sphaera.clusterers.registry import CLUSTERERS
from sphaera.operators import grids, harness, metrics, scaling
from sphaera.plans.relational import Query, rounded, samples
from sphaera.session import tables
from sphaera.sources import files
from sphaera.streaming import scoring

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RUN_METRICS = ("acc", "nmi", "f_measure")
PARAMS = ["p1", "p2", "sigma", "theta"]


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


RUNS = "r AS (SELECT DISTINCT * REPLACE (upper(substring(trim(dataset), 1, 1)) || lower(substring(trim(dataset), 2)) AS dataset) FROM all_runs)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables(spark, sf_dir, "all_runs").withColumn("dataset", harness.tidy_name(F.col("dataset")))
    return harness.latest_runs(r, "run_id", "logged_at")


@query("q_status_counts", f"WITH {RUNS} SELECT status, count(*) AS n FROM r GROUP BY status")
def q_status_counts(spark, sf_dir):
    return harness.status_counts(runs(spark, sf_dir))


_SUMMARY = ", ".join(f"round(avg({m}) FILTER (good AND isfinite({m})), 6) AS {m}_mean, round(stddev_pop({m}) FILTER (good AND isfinite({m})), 6) AS {m}_std" for m in RUN_METRICS)
SUMMARY = f"""{RUNS}, g AS (SELECT *, status = 'success' AS good FROM r),
u AS (SELECT grid_id, dataset, algorithm, count(*) FILTER (good AND isfinite(acc)) AS success_runs, {_SUMMARY}, round(avg(runtime_seconds) FILTER (good AND isfinite(runtime_seconds)), 6) AS runtime_seconds_mean,
round(sum(runtime_seconds) FILTER (good AND isfinite(runtime_seconds)), 6) AS runtime_seconds_sum FROM g GROUP BY grid_id, dataset, algorithm)"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = harness.summarise(runs(spark, sf_dir), ["grid_id", "dataset", "algorithm"], RUN_METRICS)
    return rounded(s, *[c for c in s.columns if c.endswith(("_mean", "_std", "_sum"))])


@query("q_grid_summary", f"WITH {SUMMARY} SELECT * FROM u")
def q_grid_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query("q_best_params", f"""WITH {SUMMARY} SELECT dataset, algorithm, grid_id, acc_mean FROM u WHERE success_runs = 3 AND isfinite(acc_mean)
QUALIFY row_number() OVER (PARTITION BY dataset, algorithm ORDER BY acc_mean DESC, nmi_mean DESC NULLS LAST, f_measure_mean DESC NULLS LAST, grid_id) = 1""")
def q_best_params(spark, sf_dir):
    return harness.best_setting(summary(spark, sf_dir), ["dataset", "algorithm"], ["grid_id"], 3).select("dataset", "algorithm", "grid_id", "acc_mean")


@query("q_benchmark_summary", f"""WITH {SUMMARY}, n AS (SELECT dataset, algorithm, count(*) AS settings, sum(success_runs)::BIGINT AS runs, max(acc_mean) FILTER (success_runs = 3) AS best_acc FROM u GROUP BY dataset, algorithm)
SELECT dataset, algorithm, settings, runs, best_acc FROM n""")
def q_benchmark_summary(spark, sf_dir):
    s = summary(spark, sf_dir)
    return s.groupBy("dataset", "algorithm").agg(F.count("*").alias("settings"), F.sum("success_runs").alias("runs"), F.max(F.when(F.col("success_runs") == 3, F.col("acc_mean"))).alias("best_acc"))


@query("q_resume_antijoin", """SELECT DISTINCT g.grid_id, s.seed FROM grid_summary g, (SELECT unnest([1, 2, 3]) AS seed) s
WHERE NOT EXISTS (SELECT 1 FROM all_runs r WHERE r.grid_id = g.grid_id AND r.seed = s.seed AND r.status = 'success')""")
def q_resume_antijoin(spark, sf_dir):
    plan = tables(spark, sf_dir, "grid_summary").select("grid_id").distinct().select("grid_id", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])).alias("seed"))
    done = tables(spark, sf_dir, "all_runs").where("status = 'success'").select("grid_id", "seed")
    return plan.join(done, ["grid_id", "seed"], "left_anti")


@query("q_selected_features", f"WITH {RUNS} SELECT algorithm, min(selected_p1) AS least, max(selected_p1) AS most FROM r GROUP BY algorithm")
def q_selected_features(spark, sf_dir):
    return harness.feature_count_range(runs(spark, sf_dir), ["algorithm"], "selected_p1")


# Sums of millionths are exact, so neither the order of summation nor a tie of rounding shows.
@query("q_metric_spread", f"""WITH {RUNS}, m AS (SELECT algorithm, CAST(round(ari * 1000000) AS BIGINT) AS v FROM r WHERE status = 'success' AND isfinite(ari)),
s AS (SELECT algorithm, CAST(sum(v) AS DOUBLE) AS a, CAST(sum(CAST(v * v AS DECIMAL(38, 0))) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY algorithm)
SELECT algorithm, floor(a / n + 0.5) / 1000000 AS ari_mean, floor(sqrt(greatest(b / n - (a / n) * (a / n), 0)) + 0.5) / 1000000 AS ari_std FROM s""")
def q_metric_spread(spark, sf_dir):
    r = runs(spark, sf_dir).where("status = 'success' and ari is not null and not isnan(ari) and abs(ari) < double('inf')")
    return harness.exact_spread(r, "algorithm", "ari")


@query("q_error_types", f"WITH {RUNS} SELECT algorithm, error_type, count(*) AS n FROM r WHERE status = 'failed' GROUP BY algorithm, error_type")
def q_error_types(spark, sf_dir):
    return runs(spark, sf_dir).where("status = 'failed'").groupBy("algorithm", "error_type").agg(F.count("*").alias("n"))


@query("q_seed_agreement", f"""WITH {RUNS} SELECT a.grid_id, a.seed AS seed_a, b.seed AS seed_b, round(abs(a.acc - b.acc), 6) AS gap FROM r a JOIN r b ON a.grid_id = b.grid_id AND a.seed < b.seed
WHERE a.status = 'success' AND b.status = 'success' AND isfinite(a.acc) AND isfinite(b.acc)""")
def q_seed_agreement(spark, sf_dir):
    r = runs(spark, sf_dir).where("status = 'success' and acc is not null and not isnan(acc)").select("grid_id", "seed", "acc")
    o = r.select("grid_id", F.col("seed").alias("seed_b"), F.col("acc").alias("acc_b"))
    return r.join(o, "grid_id").where("seed < seed_b").select("grid_id", F.col("seed").alias("seed_a"), "seed_b", F.round(F.abs(F.col("acc") - F.col("acc_b")), 6).alias("gap"))


@query("q_runtime_rank", f"WITH {RUNS} SELECT algorithm, run_id, CAST(row_number() OVER (PARTITION BY algorithm ORDER BY runtime_seconds, run_id) AS INTEGER) AS place FROM r WHERE runtime_seconds IS NOT NULL QUALIFY place <= 5")
def q_runtime_rank(spark, sf_dir):
    r = runs(spark, sf_dir).where("runtime_seconds is not null")
    place = F.row_number().over(Window.partitionBy("algorithm").orderBy("runtime_seconds", "run_id"))
    return r.withColumn("place", place).where("place <= 5").select("algorithm", "run_id", "place")


# Sources, sinks and the stream.


@query("q_csv_round_trip", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def q_csv_round_trip(spark, sf_dir):
    path = session.scratch_path(spark, "csv")
    files.write_csv(tables(spark, sf_dir, "supplier"), path, ["s_suppkey", "s_nationkey", "s_acctbal"])
    back = files.read_csv(spark, path)
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("q_json_round_trip", "SELECT n_nationkey, n_regionkey FROM nation")
def q_json_round_trip(spark, sf_dir):
    path = session.scratch_path(spark, "json")
    n = tables(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    n.write.json(path)
    return spark.read.schema(n.schema).json(path)


@query("q_delimited_text", "SELECT c_custkey AS sample_id, round(c_acctbal, 6) AS f0, CAST(c_nationkey AS DOUBLE) AS f1, c_mktsegment AS label FROM customer")
def q_delimited_text(spark, sf_dir):
    path = session.scratch_path(spark, "text")
    c = tables(spark, sf_dir, "customer")
    c.select(F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.lit("  "), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("value")).write.text(path)
    t = files.read_delimited(spark, [path], sep=None, id_at=0, label_at=3)
    return t.select(F.col("row_id").cast("long").alias("sample_id"), F.round(F.col("features")[0], 6).alias("f0"), F.col("features")[1].alias("f1"), "label")


@query("q_event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_event_windows(spark, sf_dir):
    return scoring.windowed_counts(spark, f"{sf_dir}/events.parquet", "ts", "event_type", "1 hour").select("window_start", "event_type", "n")


@query("q_stream_scores", """WITH s AS (SELECT vec_id AS sample_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), a AS (SELECT sample_id AS label, x AS ax FROM s ORDER BY sample_id LIMIT 20)
SELECT sample_id, label FROM s, a QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY list_distance(x, ax), label) = 1""")
def q_stream_scores(spark, sf_dir):
    s = samples(spark, sf_dir).select("sample_id", "features")
    return scoring.score_stream(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "embedding", s.orderBy("sample_id").limit(20))


# The clusterers over the catalogue's largest dataset, whose classes its catalogue counts.


@query("q_benchmark_samples", """WITH c AS (SELECT dataset_name, n_features FROM dataset_catalog WHERE dataset_name = 'Marrowmere'),
u AS (SELECT DISTINCT ON (d.sample_id) d.sample_id, d.x, d.y FROM dataset d JOIN c USING (dataset_name)
WHERE d.x IS NOT NULL AND len(d.x) = c.n_features AND len(list_filter(d.x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 ORDER BY d.sample_id, d.loaded_at DESC),
l AS (SELECT sample_id, unnest(x) AS v, unnest(generate_series(1, len(x))) AS f FROM u), r AS (SELECT f, min(v) AS lo, max(v) AS hi FROM l GROUP BY f)
SELECT sample_id, CAST(l.f - 1 AS INTEGER) AS f, round((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS v FROM l JOIN r USING (f)""")
def q_benchmark_samples(spark, sf_dir):
    return rounded(scaling.long_form(benchmark(spark, sf_dir)[0]), "v")


def benchmark(spark: SparkSession, sf_dir: str, name: str = "Marrowmere") -> tuple[DataFrame, int]:
    """The scaled samples of a dataset of the catalogue and its number of classes, 2 at least."""
    catalog = tables(spark, sf_dir, "dataset_catalog")
    s = session.materialize(scaling.min_max(scaling.dataset_samples(tables(spark, sf_dir, "dataset"), catalog, name)), "scaled")
    told = catalog.where(F.col("dataset_name") == name).agg(F.max("n_classes")).first()[0]
    return s, max(2, told or s.where("y >= 0").agg(F.countDistinct("y")).first()[0] or 2)


def _clusterer(name: str) -> None:
    @query(f"q_{name}")
    def q(spark, sf_dir):
        s, k = benchmark(spark, sf_dir)
        return CLUSTERERS[name].run(s, k, seed=1)


for _name in list(CLUSTERERS):
    _clusterer(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled embeddings, quality-pruned balls, density peaks, and the ten metrics in one row."""
    s = session.materialize(scaling.min_max(samples(spark, sf_dir)), "scaled")
    labels = CLUSTERERS["gb_pojg_gbdpc"].run(s, 10)
    return metrics.evaluate(s.select("sample_id", "y").join(labels, "sample_id"))


@query("q_flagship")
def q_flagship(spark, sf_dir):
    return rounded(flagship(spark, sf_dir), *metrics.NAMES)


@query("q_default_grids")
def q_default_grids(spark, sf_dir):
    """(algorithm, settings, runs, pending): the default grids of all clusterers over three seeds, planned against a first run."""
    s, _ = benchmark(spark, sf_dir)
    shape = scaling.validate(s)
    plan = None
    for name in sorted(CLUSTERERS):
        settings = grids.default_grid(name, shape["n_samples"], shape["max_width"])
        one = harness.plan_runs(spark, name, "Marrowmere", settings, grids.SEEDS)
        plan = one if plan is None else plan.unionByName(one)
    plan = session.materialize(plan, "grids")
    left = harness.pending(plan, plan.where("seed = 1"))
    return plan.groupBy("algorithm").agg(F.countDistinct("params").alias("settings"), F.count("*").alias("runs")).join(left.groupBy("algorithm").agg(F.count("*").alias("pending")), "algorithm")


@query("q_whole_grid")
def q_whole_grid(spark, sf_dir):
    """A whole default grid of fixed increments over three seeds, run, summarised and reduced to its best setting."""
    s, k = benchmark(spark, sf_dir)
    shape = scaling.validate(s)
    plan = harness.plan_runs(spark, "fi_gbhc", "Marrowmere", grids.default_grid("fi_gbhc", shape["n_samples"], shape["max_width"]), grids.SEEDS)
    done = harness.run_grid(s.withColumn("y", F.coalesce("y", F.lit(-1))), k, plan, session.scratch_path(spark, "runs"), labels_path=session.scratch_path(spark, "labels"))
    best = harness.best_setting(harness.summarise(done, ["algorithm", "dataset", "params"]), ["algorithm", "dataset"], ["params"], len(grids.SEEDS))
    return rounded(best.select("algorithm", "dataset", "params", "success_runs", "acc_mean", "nmi_mean", "f_measure_mean"), "acc_mean", "nmi_mean", "f_measure_mean")


@query("q_small_grid")
def q_small_grid(spark, sf_dir):
    s = session.materialize(scaling.min_max(samples(spark, sf_dir)), "scaled")
    plan = harness.plan_runs(spark, "gb_pojg_gbdpc", "embeddings", harness.grid({"gamma": [0.0], "delta": [0.5, 1.0]}), [1])
    done = harness.run_grid(s, 10, plan, session.scratch_path(spark, "runs"))
    return rounded(done.select("algorithm", "dataset", "seed", "params", "status", *metrics.NAMES), *metrics.NAMES)
