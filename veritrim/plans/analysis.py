"""The analysis of a finished log: tables, series and findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.operators.aggregates import (
    clean_log,
    condition_cells,
    family_means,
    insights,
    mean_delta,
    mean_from_cells,
    mode_series,
    only_with_both_modes,
    pivot_modes,
)
from veritrim.operators.pairing import delta_stats, latest_paired_delta, paired_delta
from veritrim.schemas import METRICS
from veritrim.sources.readers import read_results_csv
from veritrim.sources.writers import write_tables

TABLES = (
    "agg_mean_nli_per_model_compression",
    "agg_mean_hallucination_per_model_compression",
    "agg_mean_hallucination_per_model",
    "agg_mean_metrics_per_dataset",
    "delta_metrics_model_dataset",
    "delta_metrics_by_model",
    "delta_metrics_by_dataset",
)


def model_dataset_deltas(cells: DataFrame) -> DataFrame:
    """Differences of the mode means per model and dataset; no rows unless both modes occur."""
    means = mean_from_cells(cells, ["model_name", "dataset", "compressed"], ["nli_support", "hallucination"])
    wide = pivot_modes(means).select(
        "model_name", "dataset", "hallucination_0", "hallucination_1", "nli_support_0", "nli_support_1",
        "delta_nli", "delta_hallucination",
    )
    return only_with_both_modes(wide, cells)


def analysis_tables(cells: DataFrame) -> dict[str, DataFrame]:
    """The seven tables, the plot series and the findings, all from the condition cells."""
    by_mode = ["model_name", "compression_label"]
    nli_mode = mean_from_cells(cells, by_mode, ["nli_support"])
    hall_mode = mean_from_cells(cells, by_mode, ["hallucination"])
    hall_model = mean_from_cells(cells, ["model_name"], ["hallucination"])
    nli_dataset = mean_from_cells(cells, ["dataset", "compression_label"], ["nli_support"])
    deltas = model_dataset_deltas(cells)
    return {
        "agg_mean_nli_per_model_compression": nli_mode.orderBy(*by_mode),
        "agg_mean_hallucination_per_model_compression": hall_mode.orderBy(*by_mode),
        "agg_mean_hallucination_per_model": hall_model.orderBy("model_name"),
        "agg_mean_metrics_per_dataset": mean_from_cells(cells, ["dataset"], METRICS).orderBy("dataset"),
        "delta_metrics_model_dataset": deltas.orderBy("model_name", "dataset"),
        "delta_metrics_by_model": mean_delta(deltas, "model_name"),
        "delta_metrics_by_dataset": mean_delta(deltas, "dataset"),
        "series_by_model": mode_series(hall_mode, "model_name", "mean_hallucination_rate"),
        "series_by_dataset": mode_series(nli_dataset, "dataset", "mean_nli_support"),
        "series_by_family": family_means(hall_model),
        "insights": insights(cells),
    }


def analyse(log: DataFrame, out_dir: str, fmt: str = "csv", tiebreak: Sequence[str] | None = None) -> None:
    """Write every analysis table. The log is read once; what is kept for the tables is one row per condition."""
    cells = condition_cells(clean_log(log, tiebreak=tiebreak)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        write_tables(analysis_tables(cells), out_dir, fmt)
    finally:
        cells.unpersist()


def compression_effect(log: DataFrame, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Does compression change support? Latest pairs per sample, counted per model and dataset."""
    deltas = latest_paired_delta(log, tiebreak=tiebreak)
    return delta_stats(deltas, by=["model_name", "dataset"])


def post_hoc_deltas(spark: SparkSession, path: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """Delta statistics of a CSV log read strictly: a bad number in the three columns compared fails the job.

    The counts of numbers that could be read are kept alive through a condition that always holds, so that
    no column is pruned before its cast. Bad text elsewhere in the log is harmless.
    """
    text = read_results_csv(spark, path)
    numbers = {"compressed": "int", "nli_support": "double", "hallucination": "double"}
    strict = text.select(*key, *[F.col(c).cast(kind).alias(c) for c, kind in numbers.items()])
    read = strict.agg(sum((F.count(c) for c in numbers), F.lit(0)).alias("_read")).scalar()
    return delta_stats(paired_delta(strict, key).filter(read >= 0))
