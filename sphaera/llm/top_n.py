"""The N best rows of every group, by skipping row groups whose statistics rule them out.

The candidates are written clustered by group: groups are dealt into buckets, and the rows of a bucket lie in files
of small row groups, first those that may be among the best of their group, then the others by how far they are below the
best. Which may be is guessed from statistics of the group, its number of rows and its upper quantiles, halving by
halving (a sketch merged map-side); so the best rows of every group of a bucket come first, and equal scores of a group stay together. A
manifest, made of four columns of what was written, gives the greatest score of
each group in each row group; row groups that mix groups have a line for each. Row groups are read in waves in
that order, first those with likely rows; after each wave every group that has N rows has an N-th score, and a row group is skipped for good if its greatest
score of every group it contains is strictly below that group's N-th score. Equal scores are read, so the tie rule sees
all of them. A bad guess makes more row groups be read, never a wrong result. Reading, thresholds and skipping are DataFrame
work; the driver sees one flag a wave.

Buckets and depths are ranges of a sort, so a group that holds most rows spreads over many files and tasks. Row groups are
smaller where there are fewer rows (``ROWS_PER_GROUP`` at most, else a sixty-fourth of the rows).

Tie rule: the given orderings in turn, null and NaN behind every number, then the id.

Defined results for odd input: rows with a null or NaN first score or a null id are no candidates; null group
values are ordinary values; repeated rows of one id count once; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sphaera import session

ROWS_PER_GROUP, LEAST_ROWS = 20_000, 16
BUCKET = 64
HALVINGS = 9


def _last(value: Column, descending: bool) -> list[Column]:
    """Sort keys that put null and NaN behind every number."""
    missing = value.isNull() | F.isnan(value)
    number = F.when(~missing, value)
    return [missing.cast("int"), number.desc_nulls_last() if descending else number.asc_nulls_last()]


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row group of the given files: its bucket, least depth, and its groups with their greatest score."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            file = session.open_parquet(path)
            for part in range(file.metadata.num_row_groups):
                t = file.read_row_group(part, columns=["b", "depth", "g", "s0"])
                best = t.group_by(["b", "g"]).aggregate([("s0", "max"), ("depth", "min")])
                n = best.num_rows
                columns = [pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int32()), best["b"].combine_chunks(), best["depth_min"].combine_chunks(), best["g"].combine_chunks(), best["s0_max"].combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "part", "b", "depth", "g", "best"])


def _reader(columns: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted: dict[str, list[int]] = {}
            for path, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                wanted.setdefault(path, []).append(part)
            for path, parts in wanted.items():
                file = session.open_parquet(path)
                for part in sorted(parts):
                    yield from file.read_row_group(part, columns=columns).to_batches()

    return read


def top_n(candidates: DataFrame, groups: list[str], scores: list[tuple[str, bool]], id_column: str, n: int, rows_per_group: int | None = None, report: dict[str, int] | None = None) -> DataFrame:
    """(groups..., id, rank_no) of the best ``n`` of each group; scores: (column, descending), the first by descending.

    ``report`` is told how many row groups there were and how many were read.
    """
    spark = candidates.sparkSession
    named = [F.col(c).cast("double").alias(f"s{i}") for i, (c, _) in enumerate(scores)]
    key = F.xxhash64(*[F.col(c) for c in groups])
    rows = candidates.select(key.alias("g"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(groups)], F.col(id_column).cast("long").alias("id"), *named)
    rows = session.materialize(rows.where(F.col("s0").isNotNull() & ~F.isnan("s0") & F.col("id").isNotNull()), "candidates")
    order: list[Column] = []
    for i, (_, descending) in enumerate(scores):
        order += _last(F.col(f"s{i}"), descending)
    order.append(F.col("id").asc())
    by_group = ["g", *(f"g{i}" for i in range(len(groups)))]
    best = Window.partitionBy(*by_group).orderBy(*order)

    def keep(df: DataFrame) -> DataFrame:
        return df.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= n)

    halves = [1 - 0.5**k for k in range(1, HALVINGS + 1)]
    spans = rows.groupBy("g").agg(F.max("s0").alias("high"), F.min("s0").alias("low"), F.count("*").alias("of"), F.percentile_approx("s0", halves, 1 << (HALVINGS + 1)).alias("upper"))
    spans = session.materialize(spans, "spans")
    total = spans.agg(F.coalesce(F.sum("of"), F.lit(0))).first()[0]
    if rows_per_group is None:
        rows_per_group = max(LEAST_ROWS, min(ROWS_PER_GROUP, total // 64))
    buckets = max(1, total // (rows_per_group * BUCKET))
    halved = F.floor(F.log2(F.col("of") / float(n))).cast("int")
    likely = F.col("s0") >= F.when(halved < 1, F.col("low")).otherwise(F.get("upper", F.least(halved, F.lit(HALVINGS)) - 1))
    below = F.coalesce((F.col("high") - F.col("s0")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.0))
    depth = F.when(likely, F.lit(0.0)).otherwise(F.when(F.isnan(below), F.lit(0.0)).otherwise(below) + 1.0)
    clustered = rows.join(spans, "g").withColumn("depth", depth).withColumn("b", F.pmod(F.xxhash64("g", F.lit(3)), F.lit(buckets)).cast("int")).drop("high", "low", "of", "upper")
    path = session.scratch_path(spark, "topn")
    clustered = clustered.repartitionByRange("b", "depth", "g", "id").sortWithinPartitions("b", "depth", "g", "id")
    clustered.write.option("parquet.block.row.count.limit", rows_per_group).option("parquet.page.row.count.limit", rows_per_group).parquet(path)
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path")).distinct()
    manifest = session.materialize(files.mapInArrow(_manifest, "path string, part int, b int, depth double, g long, best double"), "manifest")

    parts = manifest.groupBy("path", "part").agg(F.min("b").alias("b"), F.min(F.struct("b", "depth")).alias("first"))
    place = F.row_number().over(Window.partitionBy("b", F.col("first.depth") < 1).orderBy("first", "path", "part"))
    place = F.when(F.col("first.depth") < 1, 0).otherwise(place)
    waiting = session.materialize(parts.withColumn("place", place).select("path", "part", "place"), "waiting")
    columns = [*by_group, "id", *(f"s{i}" for i in range(len(scores)))]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    read_schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in columns)
    if report is not None:
        report.update(row_groups=waiting.count(), read=0)

    taken, found = 0, None
    while True:
        these = waiting.where(f"place <= {taken}").select("path", "part")
        if report is not None:
            report["read"] += these.count()
        fresh = keep(these.repartition("path", "part").mapInArrow(_reader(columns), read_schema)).drop("rank_no")
        found = session.materialize(keep(fresh if found is None else found.unionByName(fresh)).drop("rank_no"), "found")
        bar = found.groupBy(*by_group).agg(F.count("*").alias("have"), F.min("s0").alias("bar")).groupBy("g").agg(F.min("have").alias("have"), F.min("bar").alias("bar"))
        left = waiting.where(f"place > {taken}")
        may_hold = manifest.join(left, ["path", "part"]).join(bar, "g", "left").where((F.coalesce("have", F.lit(0)) < n) | (F.col("best") >= F.col("bar")))
        waiting = session.materialize(may_hold.select("path", "part", "place").distinct(), "waiting")
        if waiting.isEmpty():
            break
        taken = taken * 4 + 1
    result = keep(found)
    return result.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(groups)], F.col("id").alias(id_column), F.col("rank_no").cast("int").alias("rank_no"))


def latest_settings(summary: DataFrame) -> DataFrame:
    """Of the rows of one ``grid_id`` only the one summarised last; rows equal in that too, by their values."""
    row = F.struct("dataset", "algorithm", "success_runs", "acc_mean", "nmi_mean", "f_measure_mean", "runtime_seconds_mean")
    when = F.coalesce("summarised_at", F.timestamp_seconds(F.lit(-62135596800)))
    return summary.where("grid_id is not null").groupBy("grid_id").agg(F.max(F.struct(when.alias("w"), row.alias("r"))).alias("m")).select("grid_id", "m.r.*")


def best_settings(summary: DataFrame, n: int = 3, complete_runs: int = 3, rows_per_group: int | None = None, report: dict[str, int] | None = None) -> DataFrame:
    """(dataset, algorithm, grid_id, rank_no): the best settings of each dataset and algorithm."""
    scores = [("acc_mean", True), ("nmi_mean", True), ("f_measure_mean", True), ("runtime_seconds_mean", False)]
    return top_n(latest_settings(summary).where(F.col("success_runs") == complete_runs), ["dataset", "algorithm"], scores, "grid_id", n, rows_per_group, report)
