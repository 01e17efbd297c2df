"""Self-consistency of response vectors stored one per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrim.functions.vectors import mean_pair_cosine, unit


def self_consistency(vectors: DataFrame, by: Sequence[str], vector_col: str) -> DataFrame:
    """Mean pairwise cosine per group without forming pairs.

    Unit vectors are summed per group and dimension, map-side first, so what is shuffled does not grow with
    the number of vectors in a group.
    """
    parts = vectors.select(*by, F.posexplode(unit(F.col(vector_col))).alias("_dim", "_x"))
    sums = parts.groupBy(*by, "_dim").agg(F.sum("_x").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    squared = sums.groupBy(*by).agg(
        F.sum(F.col("_sum") * F.col("_sum")).alias("_squared"), F.max("_n").alias("responses")
    )
    return squared.select(
        *by, "responses", mean_pair_cosine(F.col("_squared"), F.col("responses")).alias("self_consistency")
    )
