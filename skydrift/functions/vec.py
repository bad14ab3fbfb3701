"""Arithmetic on ARRAY<DOUBLE> columns with Spark's own higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(a) -> Column:
    return F.col(a).cast("array<double>") if isinstance(a, str) else a.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return _sum(a)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def l2(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def sq_dist(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def abs_dist(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length, as a normalising epsilon would give."""
    norm = l2(a) * l2(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def normalize(a: Column) -> Column:
    """Unit-length copy; the zero vector stays zero."""
    n = l2(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def scale(a: Column, c: Column) -> Column:
    return F.transform(a, lambda x: x * c)


def log_softmax(z: Column, temperature: float = 1.0) -> Column:
    t = F.transform(z, lambda x: x / F.lit(float(temperature)))
    top = F.array_max(t)
    lse = top + F.log(_sum(F.transform(t, lambda x: F.exp(x - top))))
    return F.transform(t, lambda x: x - lse)


def softmax(z: Column, temperature: float = 1.0) -> Column:
    t = F.transform(z, lambda x: x / F.lit(float(temperature)))
    top = F.array_max(t)
    e = F.transform(t, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / _sum(e))


def argmax(a: Column) -> Column:
    """Position of the first maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def mean_of(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a))
