"""Joins and rankings that hold up when one key carries a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt_to_all(df: DataFrame, most_bytes: int = 128 << 20) -> DataFrame:
    """The rows dealt to all cores, if Spark estimates them at ``most_bytes`` or less.

    For rows that cost much more than moving them: so small a table comes in one or two tasks, while a larger
    one is split by its scan and stays where it is.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= most_bytes else df


def frequent_keys(counts: DataFrame, count_col: str, most: int) -> DataFrame:
    """The keys with the highest positive counts, at most ``most`` of them: those above a count that no more keys reach.

    The count comes from a histogram by sixteenths of an octave, some hundred rows; ``counts`` is read twice. Any other key
    has a lower count than all of these.
    """
    step = F.floor(F.log2(F.col(count_col).cast("double")) * 16)
    held, least = 0, None
    for row in sorted(counts.filter(F.col(count_col) > 0).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("held")).collect(), reverse=True):
        held += row["held"]
        if held > most:
            break
        least = row["step"]
    return counts.filter(F.lit(False) if least is None else (F.col(count_col) > 0) & (step >= least))


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    values: Sequence[str],
    rows_per_task: int = 1_000_000,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Left join to a table with at most one row per key, safe against hot keys in ``facts``.

    A key with more than ``rows_per_task`` facts is split over several salts, among which its facts are dealt by input
    partition and a hash of the whole row, and its lookup row is repeated for each; so a task gets about that many rows of a key, whatever
    the size of the values. Facts without a key match nothing and are dealt out as well. Only hot keys are
    told to all tasks, at most one for ``rows_per_task`` facts. ``counts`` (key, _rows), where given, spares
    counting the facts; they need not be exact.
    """
    names = list(dict.fromkeys([*facts.columns, *values]))
    if counts is None:
        counts = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    salts = F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts")
    hot = F.broadcast(counts.filter(F.col("_rows") > rows_per_task).select(F.col(key).alias("_hot"), salts))
    dealt = facts.withColumn("_dealt", F.xxhash64(F.spark_partition_id(), *facts.columns)).join(hot, F.col(key) == F.col("_hot"), "left")
    parts = F.when(F.col(key).isNull(), 1000).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = dealt.withColumn("_salt", F.pmod("_dealt", parts).cast("int")).drop("_hot", "_salts", "_dealt")
    spread = lookup.select(F.col(key).alias("_key"), *[F.col(v).alias(f"_value_{v}") for v in values])
    spread = spread.join(hot, F.col("_key") == F.col("_hot"), "left")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)).alias("_lookup_salt")
    spread = spread.select("_key", *[f"_value_{v}" for v in values], every)
    joined = dealt.join(spread, (dealt[key] == spread["_key"]) & (dealt["_salt"] == spread["_lookup_salt"]), "left")
    found = {v: F.col(f"_value_{v}").alias(v) for v in values}
    return joined.select(*[found.get(n, F.col(n)) for n in names])


def first_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, strands: int = 200
) -> DataFrame:
    """The first ``n`` rows of every group, all of them ranked exactly.

    Each group is first cut within ``strands`` strands of input partitions, so that no task
    ever ranks a whole group; what is left, ``strands * n`` rows at most, is ranked once more.
    """
    cut = df.withColumns({"_strand_0": F.spark_partition_id() % strands, "_strand_1": F.lit(0)})
    for name in ("_strand_0", "_strand_1"):
        within = Window.partitionBy(*group, name).orderBy(*order)
        cut = cut.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= n)
    return cut.drop("_rank", "_strand_0", "_strand_1")
