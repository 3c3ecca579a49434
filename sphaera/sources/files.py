"""Readers and writers of the files experiments use.

Text readers give (row_id, features, label); binary readers give (sample_id, features, y). Blank lines are skipped;
a line with a field that is no number has null there, which validation reports.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphaera import session


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The given fields with a header; other columns are left out."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; an absent path gives an empty table without columns."""
    if not session.path_exists(spark, path):
        return spark.createDataFrame([], "")
    return spark.read.option("header", True).csv(path)


def write_json(path: str, value: Any) -> None:
    """A small settings object, indented, in UTF-8."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)


def append_labels(labels: DataFrame, path: str, **run: Any) -> None:
    """Labels of one run, in a table partitioned by the run's key."""
    keyed = labels.withColumns({k: F.lit(v) for k, v in run.items()})
    keyed.write.mode("append").partitionBy(*run).parquet(path)


def read_delimited(spark: SparkSession, paths: list[str], sep: str | None = ",", id_at: int | None = None, label_at: int | None = None, drop: tuple[int, ...] = ()) -> DataFrame:
    """(row_id, features, label) of text files stacked; ``sep`` None splits on blanks."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+") if sep is None else F.transform(F.split("value", f"\\Q{sep}\\E"), lambda v: F.trim(v))
    other = [i for i in (id_at, label_at, *drop) if i is not None]
    numbers = F.filter(F.transform(parts, lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda s: ~s["i"].isin(other) if other else F.lit(True))
    features = F.transform(numbers, lambda s: s["v"].try_cast("double"))
    at = lambda i: F.element_at(parts, i + 1) if i is not None else F.lit(None).cast("string")
    return lines.select(at(id_at).alias("row_id"), features.alias("features"), at(label_at).alias("label"))


def label_code(df: DataFrame, label: str) -> DataFrame:
    """Labels as dense integers in their order."""
    from sphaera.operators.scaling import encode_labels

    return encode_labels(df, label)


def _idx(kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                magic = int.from_bytes(raw[:4], "big")
                if magic != kind:
                    raise ValueError(f"{path}: magic number {magic}, not {kind}")
                axes = raw[3]
                shape = [int.from_bytes(raw[4 + 4 * i : 8 + 4 * i], "big") for i in range(axes)]
                x = np.frombuffer(raw, np.uint8, offset=4 + 4 * axes).reshape(shape[0], -1)
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096].astype(float)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(lo, lo + len(part)), pa.int64()), flat], names=["path", "place", "features"])

    return run


def read_idx(spark: SparkSession, images: list[str], labels: list[str]) -> DataFrame:
    """(sample_id, features, y) of image and label files in IDX form, gzipped or not, the parts stacked in order."""
    schema = "path string, place long, features array<double>"

    def read(paths: list[str], kind: int) -> DataFrame:
        out = None
        for part, p in enumerate(paths):
            rows = spark.read.format("binaryFile").load(p).select("path", "content").mapInArrow(_idx(kind), schema).withColumn("part", F.lit(part))
            out = rows if out is None else out.unionByName(rows)
        return out

    x, y = read(images, 2051), read(labels, 2049)
    both = x.join(y.select("part", "place", F.col("features")[0].cast("int").alias("y")), ["part", "place"])
    return both.select((F.col("part") * (1 << 40) + F.col("place")).alias("sample_id"), "features", "y")


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, features, y) of an array file with X and y; objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for data in batch.column(0).to_pylist():
                with np.load(io.BytesIO(data), allow_pickle=False) as z:
                    x, y = np.asarray(z["X"], float), np.asarray(z["y"]).ravel()
                if x.ndim != 2 or len(x) != len(y):
                    raise ValueError("X must be 2-D and as long as y")
                for lo in range(0, len(x), 4096):
                    part = x[lo : lo + 4096]
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part)), pa.int64()), flat, pa.array(y[lo : lo + 4096].astype(np.int32))], names=["sample_id", "features", "y"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "sample_id long, features array<double>, y int")


def write_dataset(samples: DataFrame, path: str) -> None:
    """The engine's own form of a dataset: one parquet table."""
    samples.write.mode("overwrite").parquet(path)
