"""Vector arithmetic on array columns, in whole-stage expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    # a variable: in the inner function the norm would be computed for each element
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def cosine(a: Column, b: Column) -> Column:
    """Null where a side is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def min_max(value: Column, low: Column, high: Column, flat: float = 0.0) -> Column:
    """(value - low) / (high - low); ``flat`` where the range is empty or unknown."""
    return F.coalesce(F.when(high > low, (value - low) / (high - low)), F.lit(flat))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
