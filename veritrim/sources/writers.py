"""Sinks for samples, the results log and summary tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.operators import key_index
from veritrim.operators.grid import logged_cells
from veritrim.schemas import RESULT, RESULT_LOG, SAMPLE
from veritrim.sources import commits

# The header of the summary file.

SUMMARY_COLUMNS = (
    "group",
    "count",
    "avg_exact_match",
    "avg_keyword_match",
    "avg_self_consistency",
    "avg_nli_support",
    "hallucination_rate",
)


def write_samples(samples: DataFrame, path: str) -> None:
    """One JSON object per line."""
    samples.select(*SAMPLE.names).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_results(
    rows: DataFrame,
    path: str,
    run_id: str | None = None,
    batch_id: int | None = None,
    after: dict[str, Any] | None = None,
) -> int:
    """Append to the Parquet log, one folder per dataset; returns the log's version. Nothing is appended when there are no rows.

    Rows become part of the log when its next manifest is published, all at once. ``after`` is the state of the log that the
    rows were made from (``commits.state``): when another writer has published since then, this one
    fails with ``ConcurrentCommit`` and its files are removed. The new cells join the log's index in the same step.

    Rows are rebalanced first: files get a sensible size however many tasks scored them, a large dataset is split over
    several, and a failed write does not send rows back to the models.
    """
    spark = rows.sparkSession
    path = path.rstrip("/")
    after = commits.state(spark, path) if after is None else after
    earlier = commits.data_files(spark, path) if after["version"] == 0 else []
    name = commits.new_name()
    # Nobody else writes to these partitions; written this way, a writer stages its files apart from those of others.
    balanced = rows.select(*RESULT_LOG.names, F.lit(name).alias("commit")).hint("rebalance", "dataset")
    balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "commit").parquet(path)
    files = commits.data_files(spark, path, f"dataset=*/commit={name}")
    if not files:
        return after["version"]
    segment = commits.new_name()
    added = commits.read_files(spark, path, [f["file"] for f in files + earlier], RESULT_LOG)
    index = key_index.extended(spark, path, after["table"].get("index", []), logged_cells(added), segment)
    entry = {"run_id": run_id, "batch_id": batch_id, "files": earlier + files}
    try:
        return commits.publish(spark, path, entry, after, {"index": index})
    except commits.ConcurrentCommit:
        commits.drop_folders(spark, path, f"dataset=*/commit={name}")
        commits.drop_folders(spark, path, f"{key_index.FOLDER}/segment={segment}")
        raise


def export_results_csv(log: DataFrame, path: str, mode: str = "append") -> None:
    """The result columns as CSV that ``load_results`` reads back."""
    (
        log.select(*RESULT.names)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def _write_table(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_summary(summary: DataFrame, path: str, fmt: str = "csv", digits: int | None = 4) -> None:
    """Overwrite the experiment summary, columns in their fixed order, means rounded for display."""
    means = SUMMARY_COLUMNS[2:]
    shown = [F.round(c, digits).alias(c) if digits is not None else F.col(c) for c in means]
    _write_table(summary.orderBy("group").select("group", "count", *shown), path, fmt)


def write_tables(tables: Mapping[str, DataFrame], out_dir: str, fmt: str = "csv", names: Sequence[str] = ()) -> None:
    """Overwrite one folder per table under ``out_dir``."""
    for name in names or tables:
        _write_table(tables[name], f"{out_dir}/{name}", fmt)


def publish_tables(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> int:
    """Write several tables and publish them together: readers see all of a version or none of it. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    after = commits.state(spark, path)
    folder = commits.new_name()
    for name, df in tables.items():
        _write_table(df, f"{path}/commit={folder}/{name}", fmt)
    files = commits.data_files(spark, path, f"commit={folder}")
    entry = {"commit": folder, "format": fmt, "tables": sorted(tables), "files": files}
    return commits.publish(spark, path, entry, after, kept=[])


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest version that was published; none when there is no version."""
    path = path.rstrip("/")
    entries = commits.state(spark, path)["entries"]
    if not entries:
        return {}
    last = entries[-1]
    reader = spark.read.option("header", True) if last["format"] == "csv" else spark.read
    return {n: reader.format(last["format"]).load(f"{path}/commit={last['commit']}/{n}") for n in last["tables"]}
