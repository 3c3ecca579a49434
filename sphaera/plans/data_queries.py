"""Queries of the general data problems: schema drift and small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera.operators import compaction, schema_drift
from sphaera.session import tables


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, _, _ = schema_drift.drift_report(tables(spark, sf_dir, "run_files"), tables(spark, sf_dir, "run_lines"))
    return changes.where("drift <> 'field'").select("file_id", "field_name", "drift")


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.consistent_table(tables(spark, sf_dir, "run_files"), tables(spark, sf_dir, "run_lines"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table with one column a field."""
    return schema_drift.wide_table(tables(spark, sf_dir, "run_files"), tables(spark, sf_dir, "run_lines"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compaction.compact(tables(spark, sf_dir, "prediction_files"), tables(spark, sf_dir, "all_runs"))
    return done.select("file_id", "sample_no")


def p3_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and distinct source files of each prediction after compaction."""
    done = compaction.compact(tables(spark, sf_dir, "prediction_files"), tables(spark, sf_dir, "all_runs"))
    return done.groupBy("path").agg(F.count("*").alias("n_records"), F.countDistinct("file_id").alias("n_sources"), F.sum("label").alias("label_sum"))


QUERIES = {"p2_found": p2_found, "p2_runs": p2_runs, "p2_table": p2_table, "p3_found": p3_found, "p3_predictions": p3_predictions}

_NORMAL = """
normal AS (
  SELECT DISTINCT file_id, sample_nos, labels, n_records, written_at,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(prediction_path), chr(92), '/'),
           '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g'), '^\\./', '') AS path
  FROM prediction_files
  WHERE len(labels) >= coalesce(n_records, 0)
),
whole AS (SELECT * FROM normal WHERE path IN (SELECT prediction_path FROM all_runs WHERE prediction_path IS NOT NULL)),
recs AS (SELECT path, file_id, written_at, unnest(sample_nos) AS sample_no, unnest(labels) AS label FROM whole),
kept AS (
  SELECT * FROM recs
  QUALIFY row_number() OVER (PARTITION BY path, sample_no ORDER BY written_at DESC, file_id DESC, label DESC) = 1
)"""

SQL = {
    "p3_found": f"WITH {_NORMAL} SELECT file_id, sample_no FROM kept",
    "p3_predictions": f"WITH {_NORMAL} SELECT path, count(*) AS n_records, count(DISTINCT file_id) AS n_sources, CAST(sum(label) AS BIGINT) AS label_sum FROM kept GROUP BY path",
}
