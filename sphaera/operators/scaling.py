"""Validation, statistics and scaling of (sample_id, features, y) tables.

Null features or null entries count as not finite. Repeated rows count as often as they come. Empty tables give
one row of zero counts from ``dataset_stats`` and no rows elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sphaera.functions.vectors import doubles, is_finite


def as_samples(df: DataFrame, sample_id: str, features: str, y: str | None = None) -> DataFrame:
    """(sample_id BIGINT, features ARRAY<DOUBLE>, y)."""
    columns = [F.col(sample_id).cast("long").alias("sample_id"), doubles(features).alias("features")]
    return df.select(*columns, *([F.col(y).alias("y")] if y else []))


def dataset_samples(dataset: DataFrame, catalog: DataFrame, name: str) -> DataFrame:
    """(sample_id, features, y): the samples of one dataset of the catalogue with ``n_features`` finite entries.

    Of several usable rows of one sample the one loaded last counts, then the greater values; ``y`` may be null.
    """
    width = catalog.where((F.col("dataset_name") == name) & F.col("n_features").isNotNull()).agg(F.max(F.struct("registered_at", "n_features")).alias("c")).select("c.n_features")
    rows = dataset.where((F.col("dataset_name") == name) & F.col("sample_id").isNotNull() & F.col("x").isNotNull()).select("sample_id", "x", "y", "loaded_at")
    rows = rows.crossJoin(F.broadcast(width)).where((F.size("x") == F.col("n_features")) & is_finite(F.col("x")))
    last = F.max(F.struct(F.coalesce("loaded_at", F.timestamp_seconds(F.lit(0))).alias("w"), "x", "y")).alias("m")
    return rows.groupBy(F.col("sample_id").cast("long").alias("sample_id")).agg(last).select("sample_id", doubles("m.x").alias("features"), F.col("m.y").alias("y"))


def dataset_stats(samples: DataFrame) -> DataFrame:
    """One row: samples, width, classes and unusable rows, in one pass."""
    return samples.agg(
        F.count("*").alias("n_samples"),
        F.min(F.size("features")).alias("min_width"),
        F.max(F.size("features")).alias("max_width"),
        F.countDistinct("y").alias("n_classes"),
        F.count_if(~F.coalesce(is_finite(F.col("features")), F.lit(False))).alias("n_not_finite"),
    )


def validate(samples: DataFrame, least_classes: int = 0) -> dict[str, int]:
    """Raises ValueError for empty tables, ragged or non-finite rows, and fewer than ``least_classes`` classes."""
    with_y = samples if "y" in samples.columns else samples.withColumn("y", F.lit(None).cast("int"))
    row = dataset_stats(with_y).first().asDict()
    if not row["n_samples"]:
        raise ValueError("no samples")
    if row["min_width"] != row["max_width"] or row["min_width"] < 1:
        raise ValueError("features must have one width of at least 1")
    if row["n_not_finite"]:
        raise ValueError("features must be finite")
    if row["n_classes"] < least_classes:
        raise ValueError(f"at least {least_classes} classes are needed")
    return row


def long_form(samples: DataFrame) -> DataFrame:
    """(sample_id, f, v): one row an entry."""
    return samples.select("sample_id", F.posexplode("features").alias("f", "v"))


def column_ranges(samples: DataFrame) -> DataFrame:
    """(f, lo, hi) of every column: a map-side aggregate."""
    return long_form(samples).groupBy("f").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def min_max(samples: DataFrame) -> DataFrame:
    """Every column scaled to [0, 1]; a constant column becomes 0.

    The ranges are one row of two arrays, as wide as the data, so joining them sends one row to each task.
    """
    ordered = F.array_sort(F.collect_list(F.struct("f", "lo", "hi")))
    row = column_ranges(samples).agg(ordered.alias("r")).select(F.transform("r", lambda s: s["lo"]).alias("lo"), F.transform("r", lambda s: F.when(s["hi"] > s["lo"], s["hi"] - s["lo"]).otherwise(F.lit(1.0))).alias("width"))
    scaled = F.zip_with(F.zip_with("features", "lo", lambda v, lo: v - lo), "width", lambda v, w: v / w)
    return samples.crossJoin(F.broadcast(row)).withColumn("features", scaled).drop("lo", "width")


def project_features(samples: DataFrame, order: list[int]) -> DataFrame:
    """Columns in the given order, as feature selection leaves them."""
    return samples.withColumn("features", F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.element_at("features", i + 1)))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """Adds ``code``: dense integers in the order of the labels.

    Only the distinct labels are ordered in one window; they are joined back.
    """
    codes = df.select(label).where(F.col(label).isNotNull()).distinct()
    codes = codes.withColumn("code", F.dense_rank().over(Window.orderBy(label)) - 1)
    return df.join(codes, label, "left")
