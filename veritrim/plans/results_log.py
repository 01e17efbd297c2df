"""A results log derived row by row from an events table.

It has what a log of resumed runs has: repeated keys, missing modes, clean pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrim.functions.metrics import hallucination
from veritrim.schemas import MODELS, RESULT

SMALLEST_MODEL = "TinyLlama/TinyLlama-1.1B-Chat-v1.0"
DATASETS = ("gsm8k", "squad_v2", "hotpot_qa", "trivia_qa")
EVENT_MODELS = {"view": MODELS[0], "click": MODELS[1], "signup": MODELS[2], "purchase": MODELS[3]}


def results_log(events: DataFrame) -> DataFrame:
    """The result columns and ``event_id``, which breaks ties of equal times."""
    event = F.col("event_id")
    dataset = F.element_at(F.array(*[F.lit(d) for d in DATASETS]), (event % 4 + 1).cast("int"))
    model = F.lit(None).cast("string")
    for kind, name in EVENT_MODELS.items():
        model = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(model)
    mode = (F.floor(event / 4) % 2).cast("int")
    tokens = F.floor("value").cast("int")
    support = (F.round(F.col("value") * 100).cast("bigint") % 101) / F.lit(100.0)
    return events.select(
        event,
        F.col("user_id").cast("string").alias("id"),
        dataset.alias("dataset"),
        F.coalesce(model, F.lit(SMALLEST_MODEL)).alias("model_name"),
        mode.alias("compressed"),
        tokens.alias("orig_tokens"),
        F.when(mode == 1, F.floor(tokens / 2).cast("int")).otherwise(tokens).alias("compressed_tokens"),
        F.col("props").alias("prediction"),
        F.when(event % 3 == 0, 1.0).otherwise(0.0).alias("exact_match"),
        F.when(event % 2 == 0, 1.0).otherwise(0.0).alias("keyword_match"),
        ((event % 11) / F.lit(10.0)).alias("self_consistency"),
        support.alias("nli_support"),
        hallucination(support).alias("hallucination"),
        F.substring(F.col("ts").cast("string"), 1, 10).alias("run_id"),
        F.col("ts").alias("timestamp"),
    )


def results_log_text(events: DataFrame) -> DataFrame:
    """The same log as text, with bad numbers, bad times and missing values among the rows."""
    log = results_log(events).withColumns({c: F.col(c).cast("string") for c in RESULT.names})
    tokens = F.col("orig_tokens").cast("int")
    return log.withColumns(
        {
            "nli_support": F.when(tokens < 5, F.lit("n/a")).otherwise(F.col("nli_support")),
            "hallucination": F.when(tokens.between(5, 7), F.lit(None)).otherwise(F.col("hallucination")),
            "timestamp": F.when(tokens.between(20, 40), F.lit("unknown")).otherwise(F.col("timestamp")),
        }
    )
