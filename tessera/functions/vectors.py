"""Vectors as arrays of doubles, in built-in expressions. Vectors of different lengths have no common measure: the result is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null for unequal lengths, 0 if either is (nearly) zero."""
    n = norm(a) * norm(b)
    return F.when(n > 1e-12, dot(a, b) / n).when(F.size(a) == F.size(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))


def normalized(a: Column) -> Column:
    """The unit vector; all zeros for a (nearly) zero one."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 1e-12, x / n).otherwise(F.lit(0.0)))


def usable(embedding: Column, dim: Column) -> Column:
    """Whether embedding has dim elements, none null, NaN or infinite, and not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == dim) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def weighted_average(a: Column, b: Column, rate: float) -> Column:
    """a moved towards b by rate, which is held within 0..1; null for unequal lengths."""
    r = min(1.0, max(0.0, rate))
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (1 - r) * x + r * y))
