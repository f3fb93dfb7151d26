"""Vector and set similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a vector has no length."""
    d = F.sqrt(inner(a, a)) * F.sqrt(inner(b, b))
    return F.when(d > 0, inner(a, b) / d).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(F.lit(0.0))


def overlap(q: Column, t: Column) -> Column:
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(F.array_distinct(q)), F.lit(1))


def sigmoid(x: Column) -> Column:
    return F.when(x > 140, F.lit(1.0)).when(x < -140, F.lit(0.0)).otherwise(1 / (1 + F.exp(-5 * x)))


def finite(x: Column) -> Column:
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(x)


def not_finite(x: Column) -> Column:
    """Whether a number is null, NaN or infinite."""
    return x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))


def sanitised(v: Column) -> Column:
    """An array whose elements that aren't finite are 0."""
    return F.transform(v, lambda x: F.when(not_finite(x), F.lit(0.0)).otherwise(x.cast("double")))
