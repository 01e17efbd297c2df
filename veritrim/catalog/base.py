"""Helpers shared by the catalog modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.plans.results_log import results_log

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream; the pattern matches a single file as well as a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def log_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_log(table(spark, sf_dir, "events"))


RESULTS_LOG_SQL = """
results_log AS (
  SELECT event_id,
    CAST(user_id AS VARCHAR) AS id,
    CASE event_id % 4 WHEN 0 THEN 'gsm8k' WHEN 1 THEN 'squad_v2' WHEN 2 THEN 'hotpot_qa' ELSE 'trivia_qa' END AS dataset,
    CASE event_type WHEN 'view' THEN 'microsoft/Phi-3-mini-4k-instruct'
      WHEN 'click' THEN 'mistralai/Mistral-7B-Instruct-v0.2'
      WHEN 'signup' THEN 'meta-llama/Llama-2-7b-chat-hf'
      WHEN 'purchase' THEN 'meta-llama/Meta-Llama-3-8B-Instruct'
      ELSE 'TinyLlama/TinyLlama-1.1B-Chat-v1.0' END AS model_name,
    CAST((event_id // 4) % 2 AS INTEGER) AS compressed,
    CAST(floor(value) AS INTEGER) AS orig_tokens,
    CAST(CASE WHEN (event_id // 4) % 2 = 1 THEN CAST(floor(value) AS INTEGER) // 2
      ELSE CAST(floor(value) AS INTEGER) END AS INTEGER) AS compressed_tokens,
    props AS prediction,
    CASE WHEN event_id % 3 = 0 THEN 1.0e0 ELSE 0.0e0 END AS exact_match,
    CASE WHEN event_id % 2 = 0 THEN 1.0e0 ELSE 0.0e0 END AS keyword_match,
    (event_id % 11) / 10.0e0 AS self_consistency,
    (CAST(round(value * 100) AS BIGINT) % 101) / 100.0e0 AS nli_support,
    CASE WHEN (CAST(round(value * 100) AS BIGINT) % 101) / 100.0e0 < 0.5e0 THEN 1.0e0 ELSE 0.0e0 END AS hallucination,
    substr(CAST(ts AS VARCHAR), 1, 10) AS run_id,
    ts AS "timestamp"
  FROM events
)"""

# The same log after deduplication and with the mode label.
CLEAN_LOG_SQL = (
    RESULTS_LOG_SQL
    + """,
clean AS (
  SELECT *, CASE WHEN compressed = 1 THEN 'compressed' ELSE 'uncompressed' END AS compression_label
  FROM results_log
  QUALIFY row_number() OVER (
    PARTITION BY id, dataset, model_name, compressed ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) = 1
)"""
)


def over_log(select: str) -> str:
    return f"WITH {RESULTS_LOG_SQL} {select}"


def over_clean(ctes: str, select: str) -> str:
    return f"WITH {CLEAN_LOG_SQL}{ctes} {select}"
