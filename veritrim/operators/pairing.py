"""Pairs of compressed and uncompressed rows of the same sample, and their differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.functions.metrics import exact_mean
from veritrim.operators.dedup import default_tiebreak
from veritrim.schemas import PAIR_KEY

_MEASURES = ("nli_support", "hallucination")


def _deltas(sides: DataFrame, key: Sequence[str]) -> DataFrame:
    return sides.select(
        *key,
        (F.col("nli_support_1") - F.col("nli_support_0")).alias("delta_nli"),
        (F.col("hallucination_1") - F.col("hallucination_0")).alias("delta_hallucination"),
    )


def paired_delta(log: DataFrame, key: Sequence[str] = PAIR_KEY) -> DataFrame:
    """Compressed minus uncompressed, for keys with exactly two rows, one of each mode.

    One aggregation with map-side combining; the log is not joined to itself.
    """
    mode = F.col("compressed")
    sides = log.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(mode == m).alias(f"_rows_{m}") for m in (0, 1)],
        *[F.max(F.when(mode == m, F.col(c))).alias(f"{c}_{m}") for c in _MEASURES for m in (0, 1)],
    )
    exact = (F.col("_rows") == 2) & (F.col("_rows_0") == 1) & (F.col("_rows_1") == 1)
    return _deltas(sides.filter(exact), key)


def latest_paired_delta(
    log: DataFrame,
    key: Sequence[str] = PAIR_KEY,
    time_col: str = "timestamp",
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """``paired_delta`` of the deduplicated log, in a single aggregation and a single shuffle.

    Ties in time go by ``tiebreak``, or by the default of ``keep_last``.

    The latest row of each mode is found by ``max_by``; a row without a time loses to any that has one.
    """
    mode = F.col("compressed")
    if tiebreak is None:
        tiebreak = default_tiebreak(log, (*key, "compressed", time_col))
    recency = F.struct(F.col(time_col), *[F.col(c) for c in tiebreak])

    def latest(m: int) -> Column:
        return F.max_by(
            F.struct(*[F.col(c) for c in _MEASURES]), F.when(mode == m, recency)
        )

    sides = log.groupBy(*key).agg(
        latest(0).alias("_side_0"),
        latest(1).alias("_side_1"),
        F.count_if(mode == 0).alias("_rows_0"),
        F.count_if(mode == 1).alias("_rows_1"),
        F.count_if(~F.coalesce(mode.isin(0, 1), F.lit(False))).alias("_rows_other"),
    )
    both = (F.col("_rows_0") > 0) & (F.col("_rows_1") > 0) & (F.col("_rows_other") == 0)
    flat = sides.filter(both).select(
        *key, *[F.col(f"_side_{m}.{c}").alias(f"{c}_{m}") for c in _MEASURES for m in (0, 1)]
    )
    return _deltas(flat, key)


def delta_stats(deltas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of improved, worsened and unchanged pairs, their shares, and the mean support change."""
    d = F.col("delta_nli")
    counted = deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(d > 0).alias("improved"),
        F.count_if(d < 0).alias("worsened"),
        F.coalesce(exact_mean(d), F.lit(0.0)).alias("avg_delta_nli"),
    )
    share = [
        F.try_divide(F.col(c) * 100.0, F.col("total")).alias(f"{c}_pct") for c in ("improved", "worsened")
    ]
    unchanged = (F.col("total") - F.col("improved") - F.col("worsened")).alias("unchanged")
    return counted.select(*by, "total", "improved", "worsened", unchanged, *share, "avg_delta_nli")
