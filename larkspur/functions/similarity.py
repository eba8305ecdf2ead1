"""Vector and set similarity as array expressions (double accumulation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: guard added to each norm so that a zero vector scores 0.
NORM_EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + NORM_EPSILON) * (norm(b) + NORM_EPSILON))


def l2_normalize(a: Column) -> Column:
    length = norm(a) + NORM_EPSILON
    return F.transform(a, lambda x: x.cast("double") / length)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays taken as sets; NULL when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0))


def set_cosine(a: Column, b: Column) -> Column:
    """Cosine of the 0/1 vectors of two arrays; 0 when either is empty."""
    sizes = F.size(F.array_distinct(a)) * F.size(F.array_distinct(b))
    return F.when(sizes > 0, F.size(F.array_intersect(a, b)) / F.sqrt(sizes.cast("double"))).otherwise(0.0)
