"""Grouped summaries, pivots, deltas of means, and rankings of the results log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.functions.casts import numeric, timestamp
from veritrim.functions.metrics import compression_label, exact_mean, exact_sum, is_error, model_family
from veritrim.operators.dedup import keep_last
from veritrim.schemas import FAMILY_ORDER, METRICS, NUMERIC_COLUMNS, REQUIRED_COLUMNS

# Names the summaries give to the mean of each metric.
MEAN_NAMES = {m: f"mean_{m}" for m in METRICS} | {"hallucination": "mean_hallucination_rate"}
SUMMARY_NAMES = {m: f"avg_{m}" for m in METRICS} | {"hallucination": "hallucination_rate"}


def clean_log(
    log: DataFrame,
    tiebreak: Sequence[str] | None = None,
    missing_time_wins: bool = False,
    exclude_errors: bool = False,
) -> DataFrame:
    """Deduplicate, coerce numbers, drop rows without the required values, add the mode label.

    Deduplication comes first: a later row with a bad value replaces an earlier good one and is then dropped.
    """
    has_time = "timestamp" in log.columns
    if has_time and dict(log.dtypes)["timestamp"] == "string":
        log = log.withColumn("timestamp", timestamp(F.col("timestamp")))
    last = keep_last(
        log, time_col="timestamp" if has_time else None, tiebreak=tiebreak, missing_time_wins=missing_time_wins
    )
    coerced = last.withColumns({c: numeric(F.col(c)) for c in NUMERIC_COLUMNS if c in last.columns})
    kept = coerced.dropna(subset=list(REQUIRED_COLUMNS))
    if exclude_errors:
        kept = kept.filter(~is_error(F.col("prediction")))
    return kept.withColumn("compression_label", compression_label(F.col("compressed")))


def mean_metrics(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per group; rows without the value are left out of its mean."""
    return df.groupBy(*by).agg(*[exact_mean(F.col(m)).alias(MEAN_NAMES[m]) for m in metrics])


def condition_cells(cleaned: DataFrame) -> DataFrame:
    """Sums and counts per model, dataset and mode: all the group means can be read off this small table."""
    return cleaned.groupBy("model_name", "dataset", "compressed", "compression_label").agg(
        F.count(F.lit(1)).alias("n"),
        *[exact_sum(F.col(m)).alias(f"sum_{m}") for m in METRICS],
        *[F.count(m).alias(f"n_{m}") for m in METRICS],
    )


def _mean_from_sums(metric: str) -> Column:
    return F.try_divide(exact_sum(F.col(f"sum_{metric}")), F.sum(f"n_{metric}"))


def mean_from_cells(cells: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``mean_metrics`` computed from the condition cells instead of the rows."""
    return cells.groupBy(*by).agg(*[_mean_from_sums(m).alias(MEAN_NAMES[m]) for m in metrics])


def summary_sums(log: DataFrame) -> DataFrame:
    """Row count, sums and value counts of the metrics per dataset and mode."""
    return log.groupBy("dataset", "compressed").agg(
        F.count(F.lit(1)).alias("n"),
        *[exact_sum(F.col(m)).alias(f"sum_{m}") for m in METRICS],
        *[F.count(m).alias(f"n_{m}") for m in METRICS],
    )


def summary_from_sums(sums: DataFrame) -> DataFrame:
    """Overall, per dataset and per mode: the grouping sets run over the few sums, not over the rows."""
    dataset, mode = F.col("dataset"), F.col("compressed")
    grouped = sums.groupingSets([[], [dataset], [mode]], dataset, mode).agg(
        F.grouping_id().alias("_level"),
        F.sum("n").alias("count"),
        *[_mean_from_sums(m).alias(SUMMARY_NAMES[m]) for m in METRICS],
    )
    label = (
        F.when(F.col("_level") == 3, F.lit("overall"))
        .when(F.col("_level") == 1, F.concat(F.lit("dataset="), dataset))
        .otherwise(F.concat(F.lit("compressed="), mode.cast("string")))
    )
    return grouped.filter(F.col("count") > 0).select(
        label.alias("group"), "dataset", "compressed", "count", *SUMMARY_NAMES.values()
    )


def experiment_summary(log: DataFrame) -> DataFrame:
    """Count and metric means overall, per dataset and per mode, over every row of the log.

    An empty log gives no rows.
    """
    return summary_from_sums(summary_sums(log))


def pivot_modes(means: DataFrame) -> DataFrame:
    """One row per model and dataset with the means of both modes and their difference.

    A mode that is absent leaves NULL.
    """
    measures = {"nli_support": "mean_nli_support", "hallucination": "mean_hallucination_rate"}
    # One value per cell, so max only carries it over.
    wide = means.groupBy("model_name", "dataset").agg(
        *[
            F.max(F.when(F.col("compressed") == m, F.col(source))).alias(f"{name}_{m}")
            for name, source in measures.items()
            for m in (0, 1)
        ]
    )
    return wide.withColumns(
        {
            "delta_nli": F.col("nli_support_1") - F.col("nli_support_0"),
            "delta_hallucination": F.col("hallucination_1") - F.col("hallucination_0"),
        }
    )


def mean_delta(pivoted: DataFrame, by: str) -> DataFrame:
    """Unweighted mean of the deltas per model or per dataset, best first."""
    return (
        pivoted.groupBy(by)
        .agg(exact_mean(F.col("delta_nli")).alias("delta_nli"), exact_mean(F.col("delta_hallucination")).alias("delta_hallucination"))
        .orderBy(F.col("delta_nli").desc_nulls_last(), by)
    )


def only_with_both_modes(table: DataFrame, modes: DataFrame) -> DataFrame:
    """``table`` when the rows of ``modes`` hold both 0 and 1 in ``compressed``, else no rows."""
    both = modes.agg(
        F.coalesce(F.bool_or(F.col("compressed") == 0) & F.bool_or(F.col("compressed") == 1), F.lit(False))
    ).scalar()
    return table.filter(both)


def mode_series(means: DataFrame, category: str, value: str) -> DataFrame:
    """Both mode labels of a grouped mean side by side per category; NULL where one is missing."""
    return (
        means.groupBy(category)
        .pivot("compression_label", ["uncompressed", "compressed"])
        .agg(F.max(value))
        .orderBy(category)
    )


def family_order(df: DataFrame, family_col: str = "model_family") -> DataFrame:
    """Adds ``order_idx``; families outside the fixed order are dropped.

    The five-entry lookup is a constant array, so no join is needed.
    """
    order = F.array(*[F.lit(family) for family in FAMILY_ORDER])
    position = F.array_position(order, F.col(family_col)).cast("int")
    return df.withColumn("order_idx", position - 1).filter(F.col("order_idx") >= 0)


def family_means(model_means: DataFrame) -> DataFrame:
    """Mean of the per-model hallucination means per family, in the fixed family order."""
    families = (
        model_means.withColumn("model_family", model_family(F.col("model_name")))
        .groupBy("model_family")
        .agg(exact_mean(F.col("mean_hallucination_rate")).alias("mean_hallucination_rate"))
    )
    return family_order(families).orderBy("order_idx")


def token_bins(cleaned: DataFrame, width: int = 50) -> DataFrame:
    """Rows and mean hallucination per mode and bin of prompt tokens: the scatter at any scale."""
    start = (F.floor(F.col("orig_tokens") / width) * width).cast("bigint")
    return (
        cleaned.filter(F.col("orig_tokens").isNotNull() & F.col("compressed").cast("int").isin(0, 1))
        .groupBy("compression_label", start.alias("tokens_from"))
        .agg(F.count(F.lit(1)).alias("points"), exact_mean(F.col("hallucination")).alias("mean_hallucination_rate"))
    )


def token_scatter(cleaned: DataFrame) -> DataFrame:
    """Prompt tokens against hallucination, one row per result, labelled by mode."""
    return cleaned.filter(F.col("compressed").cast("int").isin(0, 1)).select(
        "compression_label", "orig_tokens", "hallucination"
    )


def insights(cells: DataFrame) -> DataFrame:
    """Best and worst by support change, lowest hallucination, for models and datasets.

    Everything comes from the condition cells: the rows are read once and nothing is sorted.
    Names break ties. The three change findings are absent unless both modes occur.
    """
    pairs = cells.groupBy("model_name", "dataset").agg(
        *[
            F.try_divide(
                exact_sum(F.when(F.col("compressed") == m, F.col(f"sum_{c}"))),
                F.sum(F.when(F.col("compressed") == m, F.col(f"n_{c}"))),
            ).alias(f"{c}_{m}")
            for c in ("nli_support", "hallucination")
            for m in (0, 1)
        ],
        exact_sum(F.col("sum_hallucination")).alias("sum_hallucination"),
        F.sum("n_hallucination").alias("n_hallucination"),
        F.bool_or(F.col("compressed") == 0).alias("has_0"),
        F.bool_or(F.col("compressed") == 1).alias("has_1"),
    )
    model, dataset = F.col("model_name"), F.col("dataset")
    entities = pairs.groupingSets([[], [model], [dataset]], model, dataset).agg(
        F.grouping_id().alias("_level"),
        exact_mean(F.col("nli_support_1") - F.col("nli_support_0")).alias("delta_nli"),
        exact_mean(F.col("hallucination_1") - F.col("hallucination_0")).alias("delta_hall"),
        _mean_from_sums("hallucination").alias("rate"),
        (F.bool_or("has_0") & F.bool_or("has_1")).alias("_both"),
    )
    entity = F.when(F.col("_level") == 1, model).when(F.col("_level") == 2, dataset)
    row = F.struct(entity.alias("entity"), F.col("delta_nli"), F.col("delta_hall"), F.col("rate"))

    def pick(level: int, order: Column, needs_value: Column) -> Column:
        # The smallest (missing?, order, name) wins.
        return F.min_by(row, F.when(F.col("_level") == level, F.struct(needs_value.isNull(), order, entity)))

    delta, rate = F.col("delta_nli"), F.col("rate")
    picks = {
        "best_model_by_delta": pick(1, -delta, delta),
        "best_dataset_by_delta": pick(2, -delta, delta),
        "worst_model_by_delta": pick(1, delta, delta),
        "lowest_hallucination_model": pick(1, rate, rate),
        "lowest_hallucination_dataset": pick(2, rate, rate),
    }
    chosen = entities.agg(
        F.bool_or(F.when(F.col("_level") == 3, F.col("_both"))).alias("_both"),
        F.array(
            *[F.struct(F.lit(kind).alias("kind"), best.alias("found")) for kind, best in picks.items()]
        ).alias("_picks"),
    )
    unpacked = chosen.select("_both", F.explode("_picks").alias("_pick"))
    needs_both = F.col("_pick.kind").endswith("_by_delta")
    return unpacked.filter(
        F.col("_pick.found").isNotNull() & (~needs_both | F.coalesce(F.col("_both"), F.lit(False)))
    ).select("_pick.kind", "_pick.found.entity", "_pick.found.delta_nli", "_pick.found.delta_hall", "_pick.found.rate")


def run_counters(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rows written, rows that are error marks, and grid cells that were already in the log."""
    skipped_count = skipped.agg(F.count(F.lit(1))).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("written"),
        F.count_if(is_error(F.col("prediction"))).alias("errors"),
    ).select("written", skipped_count.alias("skipped"), "errors")
