"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the norm below which a vector counts as zero.
LEAST_NORM = 1e-12
#: Fixed value: the largest 32-bit float.
LARGEST = 3.4028234663852886e38


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """With length one; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x.cast("double") / n)


def is_vector(v: Column, dim: int) -> Column:
    """Of that width, without null, NaN or infinity."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == dim) & ~bad, F.lit(False))


def repaired(v: Column, dim: int) -> Column:
    """Cut or filled with zeros to ``dim``; NaN and null become 0, infinities the largest float."""
    padded = F.slice(F.concat(F.coalesce(v, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), dim)), 1, dim)
    big = F.lit(LARGEST)
    return F.transform(padded, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).when(x > big, big).when(x < -big, -big).otherwise(x))
