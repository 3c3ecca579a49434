"""Schema drift, compaction, graph operators, readers and windows on small hand-made inputs."""

from __future__ import annotations

import datetime as dt
import gzip

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sphaera.operators import compaction, distance, graph, scaling, schema_drift, windows
from sphaera.session import delete_path, materialize, path_exists, scratch_path
from sphaera.sources import files

DAY = dt.datetime(2024, 1, 1)


def logs(spark, contents, experiment="e"):
    metas, lines = [], []
    for i, text in enumerate(contents, 1):
        metas.append((i, experiment, DAY + dt.timedelta(days=i), "clash"))
        lines += [(i, n, line, i) for n, line in enumerate(text)]
    f = spark.createDataFrame(metas, "file_id long, experiment string, written_at timestamp, names string")
    return f, spark.createDataFrame(lines, "file_id long, line_no int, line string, run long")


def changes(spark, contents):
    c, _, _ = schema_drift.drift_report(*logs(spark, contents))
    return sorted((r.file_id, r.field_name, r.drift) for r in c.where("drift <> 'field'").collect())


def test_added_removed_and_renamed(spark):
    a = ["alg,p1,acc,prediction_path", "x,3,0.5,r1", "x,4,0.6,r2", "x,5,0.7,r3"]
    b = ["﻿# note", "", '"alg";"p_1";"prediction_path";note', "x;4.0;r2;", "x;5;r3;hm", "alg;p_1;prediction_path;note", "x;7;r4"]
    assert changes(spark, [a, b]) == [(2, "acc", "removed"), (2, "note", "added"), (2, "p_1", "renamed"), (2, "p_1", "type_changed")]


def test_one_shared_value_is_no_rename(spark):
    a = ["p1,prediction_path", "3,r1", "4,r2"]
    b = ["p2,prediction_path", "4,r2", "5,r3"]
    assert changes(spark, [a, b]) == [(2, "p1", "removed"), (2, "p2", "added")]


def test_types_look_past_files_without_values_but_not_past_a_removal(spark):
    a, empty, c = ["s,prediction_path", "1,r1"], ["s,prediction_path", "NaN,r2"], ["s,prediction_path", "1.5,r3"]
    gone, text = ["prediction_path", "r4"], ["s,prediction_path", "one,r5"]
    assert changes(spark, [a, empty, c, gone, text]) == [(3, "s", "type_changed"), (4, "s", "removed"), (5, "s", "added")]


def test_repeated_rows_nulls_and_empty_logs(spark):
    f, l = logs(spark, [["s,prediction_path", "1,r1"], ["s,prediction_path", "x,r2"]])
    twice = l.unionAll(l).unionAll(spark.createDataFrame([(None, 1, "a", 1), (1, None, "a", 1), (1, 9, None, 1), (99, 0, "a,b", 1)], l.schema))
    c, _, _ = schema_drift.drift_report(f.unionAll(f), twice)
    assert [(r.file_id, r.field_name) for r in c.where("drift = 'type_changed'").collect()] == [(2, "s")]
    c, _, _ = schema_drift.drift_report(f.limit(0), l.limit(0))
    assert c.isEmpty()
    assert schema_drift.consistent_table(f.limit(0), l.limit(0)).isEmpty()


def test_consistent_table_keeps_first_names_and_typed_branches(spark):
    a = ["p1,prediction_path", "3,r1", "4,r2"]
    b = ["p_1,prediction_path", "3.0,r1", "4,r2", "count:5,r3"]
    rows = {(r.prediction_path, r.field): r for r in schema_drift.consistent_table(*logs(spark, [a, b])).collect()}
    assert rows["r1", "p1"].value == "3.0" and rows["r1", "p1"].as_decimal == 3.0 and rows["r1", "p1"].as_integer is None
    assert rows["r3", "p1"].as_text == "count:5" and rows["r2", "p1"].as_integer == 4


def test_consistent_table_keeps_lines_without_a_path(spark):
    a = ["alg,p1,prediction_path", "x,3,r1", "x,4", "y,5,NaN", "x,4"]
    b = ["alg,p1", "z,6"]
    rows = {(r.prediction_path, r.file_id, r.line_no, r.field, r.value) for r in schema_drift.consistent_table(*logs(spark, [a, b])).collect()}
    path = {("r1", None, None, "alg", "x"), ("r1", None, None, "p1", "3"), ("r1", None, None, "prediction_path", "r1")}
    cut = {(None, 1, n, f, v) for n, alg, p1 in [(2, "x", "4"), (3, "y", "5"), (4, "x", "4")] for f, v in [("alg", alg), ("p1", p1)]}
    assert rows == path | cut | {(None, 2, 1, "alg", "z"), (None, 2, 1, "p1", "6")}


def test_odd_quotes_are_cells():
    assert schema_drift._split('a,"9,50",b', ",") == ["a", "9,50", "b"]
    assert schema_drift._split('a,"9', ",") == ["a", "9"]
    assert schema_drift.parse_header("﻿a; b; c") == (";", ("a", "b", "c"))


def predictions(spark, rows):
    return spark.createDataFrame(rows, "file_id long, prediction_path string, sample_nos array<int>, labels array<int>, n_records int, written_at timestamp, unit string")


def runs(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "prediction_path string")


def test_paths_that_lead_to_one_place(spark):
    paths = ["a/b/c.npy", "a//b/./c.npy", ".\\a\\b\\c.npy", "./a/b/x/../c.npy", " a/b/c.npy  "]
    df = runs(spark, paths)
    got = df.select(compaction.normal_path(df.prediction_path).alias("p")).distinct().collect()
    assert [r.p for r in got] == ["a/b/c.npy"]
    other = runs(spark, ["/a/b", "../a", "", "a/.."])
    assert [r.p for r in other.select(compaction.normal_path(other.prediction_path).alias("p")).collect()] == ["/a/b", "../a", "", ""]


def test_latest_copy_stays_and_odd_files_do_not_count(spark):
    t = lambda d: DAY + dt.timedelta(days=d)
    rows = [
        (1, "p/a", [1, 2], [0, 0], 2, t(1), "u"),
        (2, "p//a", [2, 3], [5, 5], 2, t(2), "u"),
        (3, "p\\a", [3], [6], 1, t(2), "u"),
        (3, "p\\a", [3], [6], 1, t(2), "u"),
        (4, "p/a", [9], [1], 2, t(9), "u"),
        (5, "p/zz", [1], [1], 1, t(9), "u"),
        (6, "p/a", [], [], 0, t(9), "u"),
        (7, None, [1], [1], 1, t(9), "u"),
        (8, "p/a", None, None, None, t(9), "u"),
        (None, "p/a", [1], [1], 1, t(9), "u"),
        (9, "p/a", [None, 4], [1, None], None, None, "u"),
    ]
    done = compaction.compact(predictions(spark, rows), runs(spark, ["p/a", "p/a", None]))
    assert sorted((r.file_id, r.sample_no, r.label) for r in done.collect()) == [(1, 1, 0), (2, 2, 5), (3, 3, 6), (9, 4, None)]


def test_compaction_in_many_levels_and_shards_resumes(spark):
    rng = np.random.default_rng(0)
    rows, best = [], {}
    for i in range(1, 120):
        numbers = sorted(set(rng.integers(0, 200, 4).tolist()))
        rows.append((i, "p/a", numbers, [i] * len(numbers), len(numbers), DAY + dt.timedelta(days=int(rng.integers(5))), "u"))
        for s in numbers:
            best[s] = max(best.get(s, (DAY, 0)), (rows[-1][5], i))
    root = scratch_path(spark, "compaction")
    make = lambda: compaction.compact(predictions(spark, rows), runs(spark, ["p/a"]), root, fan_in=4, target_records=150, smallest_tier=2)
    first = sorted((r.sample_no, r.file_id) for r in make().collect())
    assert first == sorted((s, i) for s, (_, i) in best.items())
    journal = compaction.SizeTieredCompactor(root).journal(spark)
    levels = journal.select("level").distinct().count()
    assert levels >= 3 and journal.where("size(inputs) > 4 and not last").isEmpty()
    before = journal.count()
    assert sorted((r.sample_no, r.file_id) for r in make().collect()) == first
    assert compaction.SizeTieredCompactor(root).journal(spark).count() == before


def test_compaction_of_nothing(spark):
    assert compaction.compact(predictions(spark, []), runs(spark, ["p/a"])).isEmpty()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_equal_union_find(spark, edges):
    root = {i: i for i in range(26)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    touched = {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: find(i) for i in touched}


def test_long_path_is_one_component(spark):
    df = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert graph.connected_components(df).select("component").distinct().collect()[0].component == 0


def test_successors_cross_partitions(spark):
    rows = [(g, v) for g in range(3) for v in range(g, 200, g + 1)]
    got = sorted((r.g, r.a, r.b) for r in graph.successors(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v").collect())
    want = sorted((g, v[i], v[i + 1]) for g in range(3) for v in [list(range(g, 200, g + 1))] for i in range(len(v) - 1))
    assert got == want


def test_knn_in_several_blocks_with_ties(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "sample_id long, features array<double>")
    one = sorted(map(tuple, distance.knn(df, 4).collect()))
    monkeypatch.setattr(distance, "BLOCK_BYTES", 500)
    many = sorted(map(tuple, distance.knn(df, 4).collect()))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = sorted((i, j, d[i, j], r + 1) for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (d[i, j], j))[:4]))
    assert one == many == want


def test_empty_inputs_of_the_relational_operators(spark):
    none = spark.createDataFrame([], "sample_id long, features array<double>")
    assert distance.knn(none, 3).isEmpty() and scaling.min_max(none).isEmpty()
    assert windows.local_spread(scaling.long_form(none), 3).isEmpty()


def test_readers(spark, tmp_path):
    x = np.arange(24, dtype=np.uint8).reshape(3, 2, 4)
    (tmp_path / "x").write_bytes(gzip.compress(bytes([0, 0, 8, 3]) + b"".join(n.to_bytes(4, "big") for n in x.shape) + x.tobytes()))
    (tmp_path / "y").write_bytes(bytes([0, 0, 8, 1]) + (3).to_bytes(4, "big") + bytes([7, 8, 9]))
    got = files.read_idx(spark, [str(tmp_path / "x")], [str(tmp_path / "y")]).orderBy("sample_id").collect()
    assert [r.y for r in got] == [7, 8, 9] and got[1].features == x[1].ravel().astype(float).tolist()
    np.savez(tmp_path / "z.npz", X=np.ones((3, 2)), y=np.array([0, 1, 1]))
    assert files.read_npz(spark, str(tmp_path / "z.npz")).count() == 3
    (tmp_path / "t.txt").write_text("a,1,2.5,k\n\nb,3,x,m\n")
    rows = files.read_delimited(spark, [str(tmp_path / "t.txt")], ",", id_at=0, label_at=3).collect()
    assert [(r.row_id, r.features, r.label) for r in rows] == [("a", [1.0, 2.5], "k"), ("b", [3.0, None], "m")]
    with pytest.raises(Exception):
        files.read_idx(spark, [str(tmp_path / "y")], [str(tmp_path / "y")]).collect()
    assert files.read_csv(spark, str(tmp_path / "absent")).count() == 0


def test_long_columns_are_cut_into_ranges(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (200, 2)).astype(float)
    long = scaling.long_form(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "sample_id long, features array<double>")).repartition(6)
    for f in (lambda limit: windows.local_spread(long, 4, limit), lambda limit: windows.prefix_sum(long, limit)):
        plain, cut = (sorted(tuple(round(v, 9) for v in r) for r in f(limit).collect()) for limit in (1000, 17))
        assert plain == cut


def test_order_statistics_of_long_columns(spark):
    values = [float(v) for v in np.random.default_rng(4).integers(0, 50, 3000)] + [float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for place in (0, 1, 1499, 2998, 2999):
        assert windows.order_statistic(df, "v", place, limit=20) == sorted(values[:-1])[place]
    assert windows.order_statistic(df.limit(0), "v", 0) is None


def test_scratch_tables_live_in_the_shared_folder(spark):
    path = scratch_path(spark, "t")
    assert spark.sparkContext.applicationId in path
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    delete_path(spark, path)
    assert not path_exists(spark, path)
    kept = materialize(spark.range(5).withColumnRenamed("id", "v"))
    assert sorted(r.v for r in kept.collect()) == list(range(5)) and kept.inputFiles()[0].find("sphaera") > 0


def test_groups_keep_their_own_exchange_behind_an_aggregate_on_the_same_keys(spark):
    from sphaera import session

    sums = spark.range(100).selectExpr("id % 7 AS k", "id AS v").groupBy("k").agg(F.sum("v").alias("v"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan(sums.repartition("k"))  # the planner drops the plain one
    grouped = session.by_group(sums, "k")
    assert "REPARTITION_BY_COL" in plan(grouped)
    assert grouped.columns == ["k", "v"] and grouped.count() == 7


def test_compaction_takes_in_later_files_and_only_those(spark):
    root = scratch_path(spark, "compaction")
    row = lambda i, numbers, day, path="p/a": (i, path, numbers, [i] * len(numbers), len(numbers), DAY + dt.timedelta(days=day), "u")
    known = runs(spark, ["p/a", "p/b"])
    run = lambda rows, **more: sorted((r.path, r.sample_no, r.file_id) for r in compaction.compact(predictions(spark, rows), known, root, **more).collect())
    early = [row(1, [1, 2], 1), row(2, [2, 3], 2)]
    assert run(early) == [("p/a", 1, 1), ("p/a", 2, 2), ("p/a", 3, 2)]
    late = [row(3, [3, 4], 0), row(4, [1], 5), row(5, [7, 8], 1, "p/b")]
    want = [("p/a", 1, 4), ("p/a", 2, 2), ("p/a", 3, 2), ("p/a", 4, 3), ("p/b", 7, 5), ("p/b", 8, 5)]
    assert run(early + late) == want
    journal = compaction.SizeTieredCompactor(root).journal(spark)
    taken = sorted(u for r in journal.where("level = 1").collect() for u in r.inputs or [])
    assert [int(u[1:]) for u in taken] == [1, 2, 3, 4, 5]
    before = journal.count()
    assert run(late) == want and run([]) == want
    assert compaction.SizeTieredCompactor(root).journal(spark).count() == before
    assert journal.where("last").agg(F.max("n_records")).first()[0] == 6


def test_compaction_grows_its_shards_and_leaves_other_shards_alone(spark):
    root = scratch_path(spark, "compaction")
    known = runs(spark, ["p/a", "p/b", "p/c"])
    rng = np.random.default_rng(1)
    rows, best = [], {}
    for i in range(1, 40):
        path, numbers = f"p/{'abc'[i % 3]}", sorted(set(rng.integers(0, 90_000, 30).tolist()))
        rows.append((i, path, numbers, [i] * len(numbers), len(numbers), DAY + dt.timedelta(days=int(rng.integers(5))), "u"))
        for s in numbers:
            best[path, s] = max(best.get((path, s), (DAY, 0)), (rows[-1][5], i))
    kept = {"fan_in": 3, "target_records": 40, "smallest_tier": 8}
    for upto in (4, 5, 39, 39):
        done = compaction.compact(predictions(spark, rows[:upto]), known, root, **kept)
    assert {(r.path, r.sample_no): r.file_id for r in done.collect()} == {k: i for k, (_, i) in best.items()}
    journal = compaction.SizeTieredCompactor(root).journal(spark)
    assert journal.agg(F.max("shards")).first()[0] > journal.agg(F.min("shards")).first()[0]
    assert done.count() == len(best)


def test_broken_off_compaction_is_taken_up_again(spark):
    root = scratch_path(spark, "compaction")
    rows = [(i, "p/a", [i, i + 1], [i, i], 2, DAY, "u") for i in range(1, 30)]
    make = lambda: sorted((r.sample_no, r.file_id) for r in compaction.compact(predictions(spark, rows), runs(spark, ["p/a"]), root, fan_in=4, smallest_tier=2).collect())
    want = make()
    last = max(r.tx for r in compaction.SizeTieredCompactor(root).journal(spark).select("tx").distinct().collect())
    delete_path(spark, f"{root}/journal/tx={last}/_SUCCESS")
    assert make() == want
    delete_path(spark, f"{root}/journal/tx={last}")
    delete_path(spark, f"{root}/data/tx={last}")
    assert make() == want


def test_wide_table_has_one_column_a_field_in_its_fused_type(spark):
    a = ["alg,p1,acc,P1,file_id,prediction_path", "x,3,0.5,u,7,r1", "y,4,1,v,8,r2", "z,,,,,"]
    b = ["algo,p1,acc,P1,file_id,prediction_path,extra", "x,3.5,0.5,u,7,r1,99999999999999999999", "y,4,1,v,8,r2,", "w,6,2,t,9,r3,5"]
    wide = schema_drift.wide_table(*logs(spark, [a, b]))
    kinds = dict(wide.dtypes)
    assert kinds["alg"] == "string" and kinds["acc"] == "double" and "algo" not in kinds
    assert sorted(c for c in wide.columns if c.lower().startswith("p1")) == ["P1", "p1_2"] and kinds["p1_2"] == "double" and kinds["file_id_2"] == "bigint"
    assert kinds["extra"] in ("string", "double")
    rows = {r["prediction_path"]: r for r in wide.collect()}
    assert set(rows) == {"r1", "r2", "r3", None} and rows[None]["alg"] == "z" and rows[None]["line_no"] == 3
    assert rows["r1"]["p1_2"] == 3.5 and rows["r3"]["file_id_2"] == 9 and rows["r2"]["acc"] == 1.0
    assert schema_drift.wide_table(*(df.limit(0) for df in logs(spark, [a]))).isEmpty()


def test_runs_are_those_of_a_plain_reading(spark, small):
    import pandas as pd

    from sphaera.plans.data_queries import p2_runs
    from tests.test_drift_brute_force import read

    files_ = pd.read_parquet(f"{small}/run_files.parquet").drop_duplicates("file_id")
    lines = pd.read_parquet(f"{small}/run_lines.parquet").drop_duplicates(["file_id", "line_no"]).sort_values(["file_id", "line_no"]).groupby("file_id").line.apply(list)
    want: dict[tuple, int] = {}
    for row in files_.itertuples():
        _, runs_, _ = read(lines[row.file_id])
        for key, values in runs_.items():
            if values:
                want[(row.experiment, key if isinstance(key, str) else (row.file_id, key))] = 1
    got = p2_runs(spark, small)
    keyed = {(r.experiment, r.prediction_path if r.prediction_path is not None else r.file_id) for r in got.select("experiment", "prediction_path", "file_id").distinct().collect()}
    assert {(e, k if isinstance(k, str) else k[0]) for e, k in want} == keyed
    n = got.select("experiment", "prediction_path", "file_id", "line_no").distinct().count()
    assert n == len(want)
