"""Vector functions over ``array<float>`` columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def problem(a: Column, dimensions: int) -> Column:
    """What is wrong with a vector: missing, dimension, not_finite, zero; null if nothing."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(a.isNull(), "missing").when(F.size(a) != dimensions, "dimension").when(bad, "not_finite").when(~F.exists(a, lambda x: x != 0), "zero")
