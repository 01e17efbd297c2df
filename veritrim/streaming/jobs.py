"""Resumable scoring of arriving samples, and a running summary of a growing log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritrim.functions.prompts import build_prompt
from veritrim.operators.aggregates import summary_from_sums, summary_sums
from veritrim.operators.prepare import sample_defaults
from veritrim.plans.experiment import Scorers, run_batch
from veritrim.schemas import Settings
from veritrim.sources import commits
from veritrim.sources.writers import publish_tables, read_tables
from veritrim.streaming.frequencies import growing_frequencies

SUMMARY = "summary"


def score_stream(
    samples: DataFrame,
    log_path: str,
    checkpoint: str,
    scorers: Scorers,
    run_id: str,
    started: datetime,
    settings: Settings = Settings(),
    frequencies: DataFrame | str | None = None,
) -> StreamingQuery:
    """Score a stream of samples into the log, each cell once across restarts, errors included.

    The checkpoint remembers the files already seen, the log the cells already done. A batch that is
    repeated finds its committed rows in the log and adds only the rest. With compression, ``frequencies`` are required:
    those of the corpus, or a folder where they grow with the stream, so that a batch's tokens are as rare as they were in all
    batches up to it. Measured in each batch alone, rarity would depend on how the samples are cut into batches.
    """
    if settings.compression_enabled and frequencies is None:
        raise ValueError("a stream with compression needs the token frequencies of its corpus, or a folder to keep them in")

    def score(batch: DataFrame, batch_id: int) -> None:
        known = frequencies
        if isinstance(known, str):
            samples = sample_defaults(batch)
            prompts = samples.select(build_prompt(F.col("context"), F.col("question")).alias("prompt"))
            known = growing_frequencies(prompts, "prompt", known, checkpoint, batch_id, settings.split)
        run_batch(batch, log_path, scorers, run_id, started, settings, batch_id, known)

    return (
        samples.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def summary_stream(log: DataFrame, summary_path: str, checkpoint: str) -> StreamingQuery:
    """Keep the experiment summary of an append-only log up to date.

    The state is one row of sums per dataset and mode, however long the log grows. Each batch publishes a version by one rename;
    ``read_summary`` reads the newest, so readers never see a half. The version before stays for its
    readers, older ones are removed.
    """

    def publish(sums: DataFrame, batch_id: int) -> None:
        before = commits.state(sums.sparkSession, summary_path)["entries"]
        publish_tables({SUMMARY: summary_from_sums(sums)}, summary_path)
        if before:
            commits.sweep(sums.sparkSession, summary_path, 0.0, keep=[before[-1]["commit"]])

    return (
        summary_sums(log)
        .writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_summary(spark: SparkSession, summary_path: str) -> DataFrame:
    """The newest version of the summary that was published; it fails when there is none."""
    return read_tables(spark, summary_path)[SUMMARY]
