"""Vector expressions; products are accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(as_double(left), as_double(right), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def normalized(vec: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    length = norm(vec)
    return F.when(length == 0, as_double(vec)).otherwise(F.transform(as_double(vec), lambda x: x / length))


def max_abs_difference(left: Column, right: Column) -> Column:
    return F.array_max(F.zip_with(as_double(left), as_double(right), lambda a, b: F.abs(a - b)))
