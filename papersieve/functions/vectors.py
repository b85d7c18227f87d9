"""Vector expressions on ARRAY columns; products accumulate in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two ARRAY<DOUBLE> columns; 0 when either is the zero vector."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(a: Column, length: Column) -> Column:
    """Unit vector; the zero vector stays zero.

    The length goes in as a zipped array: an outer expression used inside a lambda may be evaluated
    again for every element.
    """
    scale = F.array_repeat(F.when(length > 0, length).otherwise(1.0), F.size(a))
    return F.zip_with(a, scale, lambda x, n: x / n)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays read as sets; 0 when both are empty."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)
    )
