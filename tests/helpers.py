"""Shared by the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def value(spark: SparkSession, column: Column):
    return spark.range(1).select(column.alias("v")).first().v


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LOG_SCHEMA = (
    "id string, dataset string, model_name string, compressed int, orig_tokens int, prediction string, "
    "exact_match double, keyword_match double, self_consistency double, nli_support double, hallucination double, "
    "timestamp timestamp_ntz, n int"
)


def log_rows(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Log rows from what a test cares about; ``n`` is the position in the list."""
    base = {
        "id": "1", "dataset": "d", "model_name": "m", "compressed": 0, "orig_tokens": 10, "prediction": "p",
        "exact_match": 0.0, "keyword_match": 0.0, "self_consistency": 1.0, "nli_support": 0.5, "hallucination": 0.0,
        "timestamp": None,
    }
    names = [part.strip().split()[0] for part in LOG_SCHEMA.split(",")]
    data = [tuple((base | item | {"n": i})[c] for c in names) for i, item in enumerate(items)]
    return spark.createDataFrame(data, LOG_SCHEMA)
