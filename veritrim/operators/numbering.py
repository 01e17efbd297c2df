"""Gapless sequential ids per source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrim.session import written


def _div(c: Column, by: int) -> Column:
    """Whole-number division rounding down, exact over all 64 bits."""
    c, step = c.cast("bigint"), F.lit(by).cast("bigint")
    return F.call_function("div", c - F.pmod(c, step), step)


def number_capped(df: DataFrame, source: str, order: Sequence[Column], prefix: Column, id_col: str = "id") -> DataFrame:
    """``prefix`` + 1, 2, 3, … per source, for tables already cut to a bounded number of rows per source."""
    position = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return df.withColumn(id_col, F.concat(prefix, position.cast("string")))


def _rows_before(sizes: DataFrame, source: str, step: int) -> DataFrame:
    """Rows of the source in earlier blocks, for every block.

    Blocks are summed up in turn by ``step`` neighbouring ones, so that a source with very many sparse blocks is
    not added up in one task.
    """
    grouped = sizes.withColumn("_span", _div(F.col("_block"), step))
    spans = grouped.groupBy(source, "_span").agg(F.sum("_rows").alias("_span_rows"))

    def earlier(what: str, by: Sequence[str], order: str) -> Column:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(what).over(window), F.lit(0))

    span_starts = spans.select(source, "_span", earlier("_span_rows", [source], "_span").alias("_span_start"))
    within = grouped.withColumn("_within", earlier("_rows", [source, "_span"], "_block"))
    joined = null_safe_join(within, span_starts, [source, "_span"])
    return joined.select(source, "_block", (F.col("_span_start") + F.col("_within")).alias("_start"))


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join in which NULL keys match each other; the key columns of the left side stay."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    return left.join(renamed, same).drop(*[f"_right_{c}" for c in on])


def number_sorted(df: DataFrame, order: Sequence[Column], prefix: Column, id_col: str = "id") -> DataFrame:
    """``prefix`` + 1, 2, 3, … over the whole table in any order, for tables of any size.

    Rows are dealt out by ranges of the order and numbered within their task; the rows in earlier tasks come
    from one count per task. The sorted table is written, so that both look at the same ranges. The order
    should be total: equal rows are numbered in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbering")
    task, position = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = placed.withColumn("_task", task)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select("_task", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(starts, "_task")
    return numbered.select(*df.columns, F.concat(prefix, (F.col("_start") + position).cast("string")).alias(id_col))


def number_all(
    df: DataFrame, source: str, order_key: str, prefix: Column, id_col: str = "id", block: int = 1_000_000
) -> DataFrame:
    """``prefix`` + 1, 2, 3, … per source in the order of an integer key, for tables of any size.

    The key must be unique within its source; rows without a key come first, in any order. Rows without a source
    are numbered as a source of their own, whose ids are NULL if the prefix is. The key range is cut into blocks of ``block`` values, so a block
    never holds more than ``block`` rows of a source. Rows are numbered within their block; the number of rows
    in earlier blocks comes from the table of block counts. Whatever the keys are, no window sees more than
    ``block`` rows, or all the spans of blocks, of which a 64-bit key has fewer than twenty million.
    """
    blocked = df.withColumn("_block", _div(F.col(order_key), block))
    sizes = blocked.groupBy(source, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    starts = _rows_before(sizes, source, block)
    within = Window.partitionBy(source, "_block").orderBy(order_key)
    numbered = null_safe_join(blocked.withColumn("_position", F.row_number().over(within)), starts, [source, "_block"])
    position = F.col("_start") + F.col("_position")
    return numbered.select(*df.columns, F.concat(prefix, position.cast("string")).alias(id_col))
