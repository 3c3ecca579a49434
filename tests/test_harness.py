from __future__ import annotations

import pytest

from sphaera.operators import harness
from sphaera.session import scratch_path


def test_counts_and_ratios():
    assert harness.counts_and_ratios([150], [0.1, 0.2], 1000) == (100, 150, 200)
    assert harness.counts_and_ratios([6], [0.5], 20) == (6, 10)
    assert harness.counts_and_ratios([2], [0.5], 10) == (2, 5)
    assert harness.floored_ratio(0.75, 7909) == 5932


def test_neighbour_values():
    assert harness.neighbour_count(0.25, 21) == 5
    assert harness.neighbour_count(0.2, 21) == 4
    assert harness.neighbour_count(50, 21) == 20
    assert harness.untag(harness.tag(5)) == 5 and harness.untag(harness.tag(0.25)) == 0.25
    for bad in (0, -1, True, "x"):
        with pytest.raises(ValueError):
            harness.neighbour_count(bad, 10)


def test_grid_drops_repeated_values():
    assert harness.grid({"a": [1, 1, 2], "b": ["x"]}) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]


def test_grid_resumes_and_failures_are_rows(spark):
    rows = [(i, [float(v)], i // 3) for i, v in enumerate([0.0, 0.1, 0.2, 4.0, 4.1, 4.2])]
    samples = spark.createDataFrame(rows, "sample_id long, features array<double>, y int")
    path = scratch_path(spark, "runs")
    plan = harness.plan_runs(spark, "gb_pojg_gbdpc", "toy", [{"delta": 0.5}], [1])
    plan = plan.unionByName(harness.plan_runs(spark, "gb_pojg_gbdpc", "toy", [{"wrong": 1}], [1]))
    runs = harness.run_grid(samples, 2, plan, path)
    assert {r.status: r.n for r in harness.status_counts(runs).collect()} == {"success": 1, "failed": 1}
    assert harness.pending(plan, runs).isEmpty()
    assert harness.run_grid(samples, 2, plan, path).count() == 2
    summary = harness.summarise(runs, ["algorithm", "params"])
    best = harness.best_setting(summary, ["algorithm"], ["params"], 1).collect()
    assert len(best) == 1 and best[0].acc_mean == 1.0


def test_summary_ignores_nan(spark):
    rows = [("a", "success", 0.5, 1.0), ("a", "success", float("nan"), 1.0), ("a", "failed", None, None)]
    runs = spark.createDataFrame(rows, "g string, status string, acc double, runtime_seconds double")
    row = harness.summarise(runs, ["g"], ["acc"]).first()
    assert row.success_runs == 1 and row.acc_mean == 0.5


def test_default_grids_have_known_parameters_and_sizes():
    from sphaera.clusterers.registry import CLUSTERERS
    from sphaera.operators.grids import default_grid

    sizes = {name: len(default_grid(name, 1000, 1000)) for name in CLUSTERERS}
    assert sizes["plgb_fsc"] == 300 and sizes["my_v0"] == 180 and sizes["my_v1"] == 1620 and sizes["my_v2"] == 192 and sizes["my_v3"] == 8100 and sizes["my_v4"] == 1620
    assert sizes["gb_pojg_gbdpc"] == 147 and sizes["gb_pojg_gbsc"] == 147 * 29 and sizes["sagbc"] == 192 and sizes["m3w"] == 286 and sizes["gb_dbscan"] == 100
    assert sizes["gbct"] == sizes["gb_dp"] == sizes["hcdc_nard"] == 1
    for name, c in CLUSTERERS.items():
        assert set(default_grid(name, 50, 4)[0]) <= set(c.parameters())
    assert all(s["p2"] < 5932 for s in default_grid("plgb_fsc", 174, 7909))


def test_command_line_runs_resumes_and_summarises(spark, small, tmp_path):
    import json

    import pytest

    from sphaera.__main__ import chosen, main

    out = str(tmp_path / "out")
    call = ["--data", small, "--out", out, "--datasets", "Marrowmere", "--algorithms", "gbsc,fi_gbhc", "--seeds", "1,2", "--settings", "1"]
    assert main(call, spark) == 0
    done = spark.read.parquet(f"{out}/runs")
    assert done.count() == 4 and done.where("status = 'success'").count() == 4
    labels = spark.read.parquet(f"{out}/labels")
    assert labels.select("algorithm", "seed").distinct().count() == 4
    assert json.load(open(f"{out}/config.json"))["algorithms"] == ["gbsc", "fi_gbhc"]
    best = spark.read.option("header", True).csv(f"{out}/best")
    assert sorted(r.algorithm for r in best.collect()) == ["fi_gbhc", "gbsc"]
    assert main([*call, "--summaries"], spark) == 0 and main(call, spark) == 0
    assert spark.read.parquet(f"{out}/runs").count() == 4
    with pytest.raises(ValueError):
        chosen("gbsc,nope", ["gbsc"], "algorithms")
    with pytest.raises(ValueError):
        chosen("gbsc,gbsc", ["gbsc"], "algorithms")


def test_parameters_out_of_range_are_refused():
    import pytest

    from sphaera.clusterers.registry import CLUSTERERS, check_parameters
    from sphaera.operators.grids import default_grid

    for name in CLUSTERERS:
        check_parameters(name, CLUSTERERS[name].parameters())
        for n, d in ((40, 3), (1000, 1000)):
            for setting in default_grid(name, n, d):
                check_parameters(name, setting)
    for name, bad in [("gbsc", {"sigma": 0.0}), ("gb_pojg_gbdpc", {"delta": 1.5}), ("gb_pojg_gbdpc", {"gamma": -1}), ("gb_dbscan", {"ratio": 1.2}), ("agc_ild", {"anchors": 33}), ("m3w", {"levels": 0}), ("my_v0", {"theta": float("nan")}), ("my_v3", {"p1": 4, "p2": 5})]:
        with pytest.raises(ValueError):
            check_parameters(name, bad)
    for name, bad in [("m3w", {"levels": 2.5}), ("gbsc", {"sigma": "1"}), ("my_v0", {"p1": True})]:
        with pytest.raises(TypeError):
            check_parameters(name, bad)
