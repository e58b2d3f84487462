"""Vector functions over arrays, evaluated in the JVM in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
