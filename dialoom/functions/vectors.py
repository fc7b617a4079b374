"""Vectors as arrays of numbers: sums run in element order, so results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hinge(positive: Column, negative: Column, margin: float = 1.0) -> Column:
    """max(0, margin - (positive - negative))."""
    return F.greatest(F.lit(0.0), F.lit(margin) - (positive - negative))
