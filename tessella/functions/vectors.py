"""Vector arithmetic on array columns; sums are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def safe_norm(v: Column) -> Column:
    """The norm, at least 1e-12, so that a zero vector divides to zeros."""
    return F.greatest(norm(v), F.lit(TINY))


def normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / safe_norm(v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (safe_norm(a) * safe_norm(b))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
