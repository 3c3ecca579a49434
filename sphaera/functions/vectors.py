"""Column expressions over ARRAY<DOUBLE> vectors; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: str | Column) -> Column:
    """A numeric array as doubles."""
    return (F.col(x) if isinstance(x, str) else x).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_finite(x: Column) -> Column:
    """Whether all entries are finite numbers."""
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def entropy_term(p: Column) -> Column:
    """-p ln p, 0 for p = 0."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(F.lit(0.0))


def position_of_max(x: Column) -> Column:
    """0-based position of the first greatest entry: the class of a one-hot row."""
    return F.array_position(x, F.array_max(x)) - 1
