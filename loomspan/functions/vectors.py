"""Vector functions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column, zero_is_null: bool = False) -> Column:
    """a scaled to length 1; a zero vector stays as it is, or becomes null."""
    scaled = lambda n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(F.lit(None) if zero_is_null else a)
    return F.get(F.transform(F.array(norm(a)), scaled), F.lit(0))  # the length is worked out once, not for each entry


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")
