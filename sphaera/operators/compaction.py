"""Size-tiered compaction of label records scattered over tiny files, run again as files arrive.

The first level takes the files that no journal entry names as inputs and merges files of one size tier ``fan_in`` at a
time into units. Further levels merge units of one shard and tier ``fan_in`` at a time until no tier holds enough
of them; a last transaction merges what is left of each shard that has several units into one. A level reads and writes only
the units it merges; all others stay where they lie.

Every level is a transaction: its outputs are written below ``data/tx=N``, then its journal entries (transaction, level,
shard, output, inputs, numbers of records) below ``journal/tx=N``; the entry's commit marker makes it valid. What counts are
the outputs of valid entries that no later valid entry has as an input. A run that was broken off leaves a
transaction without a marker, which the next run writes anew; files that arrive later are those no valid entry names. So
repeated, resumed and incremental runs neither lose nor double a record. Merging keeps, of several copies of a
record, the one written last, then the one with the larger file id; this choice is associative, so the levels may
merge in any order.

Shards come from the prediction and the block of sample numbers, so one prediction with a third of all records
spreads over many shards. Their number is that of the journal; when records outgrow it twofold it is doubled and the
last transaction moves all records to the new shards.

Defined results for odd input: a file with a null id, path or record arrays holds nothing; a null ``n_records``
declares nothing; of arrays with different lengths the shorter counts; null sample numbers are no records, null
labels are kept; a null ``written_at`` is older than any time; repeated rows and empty tables do no harm; other
columns are ignored. A file id stands for one upload: once it is taken in, other rows under it are not read again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sphaera import session

SAMPLE_BLOCK = 4096
#: About how many files or units are put in order at once when they are dealt out to merges.
DEALT = 4096
_RECORDS = "shard int, unit string, path string, sample_no int, label int, file_id long, written_at timestamp"
_JOURNAL = "tx int, level int, shards int, shard int, output string, inputs array<string>, n_inputs long, n_records long, last boolean"


def normal_path(path: Column) -> Column:
    """The place a path leads to: either slash, no empty, ``.`` or ``..`` parts, no outer blanks."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), r"\\", "/"), "/")
    rooted = F.when(F.regexp_replace(path, r"^\s+", "").rlike(r"^[/\\]"), F.lit("/")).otherwise(F.lit(""))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "") | (p == "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((p == "..") & (rooted == "/"), acc)
        .otherwise(F.concat(acc, F.array(p))),
    )
    tidy = F.concat(rooted, F.array_join(kept, "/"))
    return F.when(path.rlike(r"^[^/\\\s.][^/\\\s.]*([/.][^/\\\s.]+)*$"), path).otherwise(tidy)


def whole_files(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(file_id, path, written_at, records) of the whole files that lead to a known prediction."""
    known = runs.select("prediction_path").where("prediction_path is not null").distinct().select(normal_path(F.col("prediction_path")).alias("path")).distinct()
    pairs = F.slice(F.arrays_zip(F.col("sample_nos").alias("sample_no"), F.col("labels").alias("label")), F.lit(1), F.least(F.size("sample_nos"), F.size("labels")))
    return (
        files.select("file_id", "prediction_path", "sample_nos", "labels", "n_records", "written_at")
        .where("file_id is not null and sample_nos is not null and labels is not null")
        .where(F.size("labels") >= F.coalesce("n_records", F.lit(0)))
        .select("file_id", normal_path(F.col("prediction_path")).alias("path"), "written_at", F.filter(pairs, lambda r: r["sample_no"].isNotNull()).alias("records"))
        .join(known, "path", "left_semi")
        .select(F.col("file_id").cast("long").alias("file_id"), "path", F.col("written_at").cast("timestamp").alias("written_at"), "records")
    )


def _dealt(units: DataFrame, within: list[str], fan_in: int, smallest: int) -> DataFrame:
    """units with the columns tier, bucket and slot: those of a size are put in order by buckets and dealt out ``fan_in`` at a time."""
    tier = F.floor(F.ln(F.greatest(F.col("n") / float(smallest), F.lit(1.0))) / math.log(max(2, fan_in))).cast("int")
    units = units.withColumn("tier", tier)
    buckets = units.groupBy(*within, "tier").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("buckets"))
    units = units.join(buckets, [*within, "tier"]).withColumn("bucket", F.pmod(F.xxhash64("unit"), "buckets").cast("int")).drop("buckets")
    place = F.row_number().over(Window.partitionBy(*within, "tier", "bucket").orderBy("n", "unit"))
    return units.withColumn("slot", F.floor((place - 1) / fan_in).cast("int"))


class SizeTieredCompactor:
    """Compacts prediction files into units below ``root``; run again on the same root it takes in what is new."""

    def __init__(self, root: str, fan_in: int = 64, target_records: int = 1_000_000, smallest_tier: int = 64):
        self.root, self.fan_in, self.target, self.smallest = root, fan_in, target_records, smallest_tier

    def _committed(self, spark: SparkSession) -> list[int]:
        """The numbers of the valid transactions."""
        found = [int(n.removeprefix("tx=")) for n in session.names_in(spark, f"{self.root}/journal") if n.startswith("tx=")]
        return sorted(n for n in found if session.path_exists(spark, f"{self.root}/journal/tx={n}/_SUCCESS"))

    def journal(self, spark: SparkSession) -> DataFrame:
        """(tx, level, shards, shard, output, inputs, n_inputs, n_records, last) of every valid transaction.

        ``n_inputs`` counts the records of the inputs, ``n_records`` those that are left of them.
        """
        paths = [f"{self.root}/journal/tx={n}" for n in self._committed(spark)]
        return spark.read.schema(_JOURNAL).parquet(*paths) if paths else spark.createDataFrame([], _JOURNAL)

    def _units(self, spark: SparkSession) -> DataFrame:
        """(tx, shard, unit, n) of the units that count."""
        journal = self.journal(spark)
        used = journal.where("level > 1").select(F.explode("inputs").alias("unit")).distinct()
        made = journal.select("tx", "shard", F.col("output").alias("unit"), F.col("n_records").alias("n"))
        return made.where("unit is not null and n > 0").join(used, "unit", "left_anti")

    def _data(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        paths = [f"{self.root}/data/tx={n}" for n in numbers]
        return spark.read.schema(_RECORDS).parquet(*paths) if paths else spark.createDataFrame([], _RECORDS)

    def _commit(self, spark: SparkSession, tx: int, level: int, shards: int, rows: DataFrame, inputs: DataFrame, last: bool) -> None:
        """Write the newest copy of each record of ``rows``, then the entries of ``inputs`` (output, inputs, n_inputs)."""
        newest = F.max(F.struct("written_at", "file_id", "label")).alias("r")
        shard = F.pmod(F.xxhash64("path", F.floor(F.col("sample_no") / SAMPLE_BLOCK)), F.lit(shards)).cast("int")
        merged = rows.groupBy("output", "path", "sample_no").agg(newest).withColumn("shard", shard)
        named = F.concat("output", F.lit("-"), F.col("shard").cast("string")).alias("unit")
        merged = merged.select("shard", named, "path", "sample_no", "r.label", "r.file_id", "r.written_at")
        merged.repartition("shard").write.mode("overwrite").parquet(f"{self.root}/data/tx={tx}")
        counted = self._data(spark, [tx]).groupBy("shard", "unit").agg(F.count("*").alias("n_records"))
        counted = counted.withColumn("output", F.regexp_replace("unit", r"-\d+$", ""))
        first = F.row_number().over(Window.partitionBy("output").orderBy("shard")) == 1
        entries = inputs.join(counted.withColumn("first", first), "output", "left").select(
            F.lit(tx).alias("tx"), F.lit(level).alias("level"), F.lit(shards).alias("shards"), "shard", F.col("unit").alias("output"),
            F.when(F.coalesce("first", F.lit(True)), F.col("inputs")).alias("inputs"),
            F.when(F.coalesce("first", F.lit(True)), F.col("n_inputs")).alias("n_inputs"),
            F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"), F.lit(last).alias("last"),
        )
        entries.write.mode("overwrite").parquet(f"{self.root}/journal/tx={tx}")

    def _take_in(self, spark: SparkSession, files: DataFrame, tx: int, shards: int) -> bool:
        """First level: the new files, merged by size. False if there are none."""
        taken = self.journal(spark).where("level = 1").select(F.explode("inputs").alias("unit")).distinct()
        name = F.concat(F.lit("F"), F.lpad(F.col("file_id").cast("string"), 20, "0"))
        sized = files.withColumn("unit", name).join(taken, "unit", "left_anti")
        per_file = sized.groupBy("unit").agg(F.sum(F.size("records")).cast("long").alias("n"))
        dealt = _dealt(per_file, [], self.fan_in, self.smallest)
        output = F.concat_ws("-", F.lit(f"T{tx}"), "tier", "bucket", "slot")
        dealt = session.materialize(dealt.select("unit", "n", output.alias("output")), "dealt")
        if dealt.isEmpty():
            return False
        rows = sized.join(dealt.select("unit", "output"), "unit").select("output", "path", "file_id", "written_at", F.explode("records").alias("r"))
        rows = rows.select("output", "path", "file_id", "written_at", F.col("r.sample_no").cast("int").alias("sample_no"), F.col("r.label").cast("int").alias("label"))
        inputs = dealt.groupBy("output").agg(F.sort_array(F.collect_list("unit")).alias("inputs"), F.sum("n").alias("n_inputs"))
        self._commit(spark, tx, 1, shards, rows, inputs, False)
        return True

    def run(self, files: DataFrame) -> DataFrame:
        """files: file_id, path, written_at, records. Returns the compacted records of this and all earlier runs."""
        spark = files.sparkSession
        done = self._committed(spark)
        tx = (done[-1] if done else 0) + 1
        shards = self.journal(spark).agg(F.max("shards")).first()[0]
        if not shards:
            records = files.agg(F.coalesce(F.sum(F.size("records")), F.lit(0))).first()[0]
            shards = max(1, math.ceil(records / self.target))
        tx += self._take_in(spark, files, tx, shards)
        level = 1
        while True:
            level += 1
            units = session.materialize(self._units(spark), "units")
            dealt = _dealt(units, ["shard"], self.fan_in, self.smallest)
            full = F.count("*").over(Window.partitionBy("shard", "tier", "bucket", "slot")) == self.fan_in
            output = F.concat_ws("-", F.lit(f"T{tx}"), "shard", "tier", "bucket", "slot")
            plan = session.materialize(dealt.withColumn("full", full).where("full").select("tx", "shard", "unit", "n", output.alias("output")), "plan")
            last = plan.isEmpty()
            if last:
                records = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                grown = shards
                while records > 2 * grown * self.target:
                    grown *= 2
                several = units.groupBy("shard").agg(F.count("*").alias("m")).where((F.col("m") > 1) | F.lit(grown != shards)).select("shard")
                output = F.concat_ws("-", F.lit(f"T{tx}-last"), "shard")
                plan = session.materialize(units.join(several, "shard").select("tx", "shard", "unit", "n", output.alias("output")), "plan")
                shards = grown
                if plan.isEmpty():
                    return self._result(spark, units)
            touched = sorted(r.tx for r in plan.select("tx").distinct().collect())
            rows = self._data(spark, touched).join(plan.select("unit", "output"), "unit")
            inputs = plan.groupBy("output").agg(F.sort_array(F.collect_list("unit")).alias("inputs"), F.sum("n").alias("n_inputs"))
            self._commit(spark, tx, level, shards, rows, inputs, last)
            tx += 1
            if last:
                return self._result(spark, session.materialize(self._units(spark), "units"))

    def _result(self, spark: SparkSession, units: DataFrame) -> DataFrame:
        """The records of the units; files that hold nothing else are read as they are."""
        numbers = sorted(r.tx for r in units.select("tx").distinct().collect())
        written = self.journal(spark).where(F.col("tx").isin(numbers) & (F.col("n_records") > 0)).count()
        records = self._data(spark, numbers)
        return records if written == units.count() else records.join(units.select("unit"), "unit", "left_semi")


def compact(files: DataFrame, runs: DataFrame, root: str | None = None, **parameters) -> DataFrame:
    """The records of all prediction files, each once, in few well-sized files below ``root``."""
    spark = files.sparkSession
    whole = session.materialize(whole_files(files, runs), "files")
    return SizeTieredCompactor(root or session.scratch_path(spark, "compaction"), **parameters).run(whole)
