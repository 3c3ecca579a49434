"""Streams: arriving vectors scored against frozen anchors, and event counts in windows.

Both drain what is there and stop. Scores are stateless, so they are appended batch by batch; counts keep one row a
window and key as state, which the watermark lets go, and each batch replaces the rows it changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera import session

MAX_ANCHOR_BYTES = 64 << 20


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream; a single file is taken through its folder by name."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def _drain(df: DataFrame, mode: str, write) -> None:
    spark = df.sparkSession
    job = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", session.scratch_path(spark, "stream")).trigger(availableNow=True).start()
    job.awaitTermination()


def score_stream(spark: SparkSession, path: str, id_column: str, features: str, anchors: DataFrame) -> DataFrame:
    """(sample_id, label): the nearest anchor of each arriving vector, ties to the smaller id.

    Anchors are few and frozen; their size is checked before they go to every task.
    """
    rows = anchors.orderBy("sample_id").collect()
    ids, a = np.array([r.sample_id for r in rows]), np.array([r.features for r in rows], float)
    if a.nbytes > MAX_ANCHOR_BYTES:
        raise ValueError("too many anchors to score against in every task")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best = np.concatenate([((x[lo : lo + 1024, None, :] - a[None]) ** 2).sum(2).argmin(1) for lo in range(0, len(x), 1024)]) if len(x) else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids[best])], names=["sample_id", "label"])

    out = session.scratch_path(spark, "scores")
    arriving = _stream(spark, path).select(F.col(id_column).cast("long").alias("sample_id"), F.col(features).cast("array<double>").alias("features")).where("features is not null")
    scored = arriving.mapInArrow(nearest, "sample_id long, label long")
    _drain(scored, "append", lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    return spark.read.parquet(out).select("sample_id", "label")


def windowed_counts(spark: SparkSession, path: str, ts: str, key: str, width: str, late: str = "1 day") -> DataFrame:
    """(window_start, key, n): counts in tumbling windows; of each window the last update counts."""
    out = session.scratch_path(spark, "windows")
    timed = _stream(spark, path).where(F.col(ts).isNotNull()).select(F.col(ts).cast("timestamp").alias("at"), F.col(key))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    flat = counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n")
    _drain(flat, "update", lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"))
    return spark.read.parquet(out).groupBy("window_start", key).agg(F.max_by("n", "epoch").alias("n"))
