"""Keep-last deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrim.schemas import NATURAL_KEY

#: Place of a row in its files, as the readers give it; rows compare by it as they stand there.
FILE_ORDER = "_order"


def default_tiebreak(df: DataFrame, without: Sequence[str | None]) -> list[str]:
    """The place in the files alone, where the readers gave it; else run, batch, then every other column that has an order."""
    if FILE_ORDER in df.columns:
        return [FILE_ORDER]
    first = [c for c in ("run_id", "batch_id") if c in df.columns and c not in without]
    rest = [f.name for f in df.schema.fields if f.name not in {*first, *without} and not f.dataType.simpleString().startswith("map")]
    return first + rest


def keep_last(
    df: DataFrame,
    key: Sequence[str] = NATURAL_KEY,
    time_col: str | None = "timestamp",
    tiebreak: Sequence[str] | None = None,
    missing_time_wins: bool = False,
) -> DataFrame:
    """One row per key: the latest, then the one with the highest tie-break (NULL is lowest).

    Without ``tiebreak`` the last row as the rows stand in their files survives, if they carry ``FILE_ORDER``; else it is
    (run_id, batch_id, the other columns), as far as the table has them, so that the same row survives in every run.
    Without a time column the tie-break alone decides.

    A row without a time loses to any row that has one, or wins with ``missing_time_wins``.
    The ranking is cut to one row per key before the shuffle, so copies of a hot key never meet in one task.
    """
    order = []
    if time_col is not None:
        latest = F.col(time_col)
        order.append(latest.desc_nulls_first() if missing_time_wins else latest.desc_nulls_last())
    if tiebreak is None:
        tiebreak = default_tiebreak(df, (*key, time_col))
    order += [F.col(c).desc() for c in tiebreak] or ([] if order else [F.lit(0)])
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")
