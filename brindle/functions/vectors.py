"""Vector functions over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One less the cosine; 1 for a vector of zeros."""
    n = norm(a) * norm(b)
    return 1.0 - F.when(n > 0, dot(a, b) / n).otherwise(0.0)
