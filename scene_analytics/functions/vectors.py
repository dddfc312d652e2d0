"""Arithmetic on array columns; everything stays in the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; a vector shorter than `eps` is divided by `eps` instead."""
    v = doubles(v)
    return scale(v, F.greatest(norm(v), F.lit(eps)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded in binary, halves away from zero, as SQL engines do with doubles; what becomes zero keeps its sign."""
    r = F.round(x * 10.0**digits, 0) / 10.0**digits
    return F.when(r == 0, x * 0.0).otherwise(r)
