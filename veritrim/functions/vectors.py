"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-8


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    values = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(values, lambda x: x / F.greatest(norm, F.lit(SMALLEST_NORM)))


def mean_pair_cosine(sum_squared: Column, n: Column) -> Column:
    """Mean cosine over ordered pairs of ``n`` unit vectors, from the squared length of their sum.

    The sum of all pairwise cosines is the squared length of the vector sum, so no pairs are formed.
    """
    count = n.cast("double")
    return (
        F.when(count <= 0, F.lit(0.0))
        .when(count == 1, F.lit(1.0))
        .otherwise((sum_squared - count) / (count * (count - 1)))
    )


def response_consistency(vectors: Column) -> Column:
    """Self-consistency of the response vectors held in one row (array of arrays)."""
    n = F.coalesce(F.size(vectors), F.lit(0))
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(
        F.transform(vectors, unit), zero, lambda acc, u: F.zip_with(acc, u, lambda a, b: a + b)
    )
    squared = F.aggregate(total, F.lit(0.0), lambda acc, x: acc + x * x)
    return F.when(n > 1, mean_pair_cosine(squared, n)).otherwise(F.when(n == 1, 1.0).otherwise(0.0))
