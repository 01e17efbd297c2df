"""From model responses to rows of the results log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.functions.metrics import error_text, exact_match, hallucination, keyword_match
from veritrim.functions.text import first_or_empty, normalize_text
from veritrim.schemas import METRICS, RESULT_LOG, Settings

# Metrics of a row that failed.
FAILED = {m: 0.0 for m in METRICS} | {"hallucination": 1.0}


def any_response(responses: Column) -> Column:
    """Stand-in for self-consistency: 1.0 when there is a response."""
    return F.when(F.size(responses) > 0, 1.0).otherwise(0.0)


def full_support(premise: Column, answer: Column) -> Column:
    """Stand-in for entailment support."""
    return F.lit(1.0)


def no_support(premise: Column, answer: Column) -> Column:
    """Support without an entailment model."""
    return F.lit(0.0)


def main_answer(responses: Column) -> Column:
    return first_or_empty(responses)


def measured(
    cells: DataFrame, support: Column, consistency: Column, settings: Settings = Settings()
) -> DataFrame:
    """Adds prediction and metrics to cells that have ``responses`` and the gold ``answer``."""
    texts = cells.withColumn("prediction", main_answer(F.col("responses"))).withColumns(
        {"_prediction": normalize_text(F.col("prediction")), "_gold": normalize_text(F.col("answer"))}
    )
    both = (F.col("prediction"), F.col("answer"))
    normal = {"normalized_prediction": F.col("_prediction"), "normalized_gold": F.col("_gold")}
    return (
        texts.withColumns(
            {
                "exact_match": exact_match(*both, **normal),
                "keyword_match": keyword_match(*both, **normal),
                "self_consistency": consistency,
                "nli_support": support,
            }
        )
        .withColumn("hallucination", hallucination(F.col("nli_support"), settings))
        .drop("_prediction", "_gold")
    )


def with_sentinels(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows with an error become marks that keep a later run from trying them again.

    A mark carries the requested mode and the values of ``FAILED``. Rows of a model that could
    not be loaded are left out.
    """
    failed = F.col("error").isNotNull()
    marked = {m: F.when(failed, F.lit(value)).otherwise(F.col(m)) for m, value in FAILED.items()}
    marked["prediction"] = F.when(
        failed, error_text(F.col("error.type"), F.col("error.message"), settings)
    ).otherwise(F.col("prediction"))
    marked["compressed"] = F.when(failed, F.col("requested_mode")).otherwise(F.col("compressed"))
    return rows.filter(~F.coalesce(F.col("error.unavailable"), F.lit(False))).withColumns(marked)


def tokens_sent(original_hash: Column, settings: Settings = Settings()) -> Column:
    """Token count of the prompt in use: counted anew when a retry shortened it."""
    shortened = F.when(F.xxhash64("prompt") != original_hash, F.col("prompt"))
    return F.when(shortened.isNull(), F.col("compressed_tokens")).otherwise(settings.count_tokens(shortened))


def result_rows(
    rows: DataFrame, run_id: str, started: Callable[[], Column] | Column, batch_id: int = 0
) -> DataFrame:
    """The columns of the results log, with the run metadata."""
    stamp = started() if callable(started) else started
    return rows.withColumns(
        {"run_id": F.lit(run_id), "timestamp": stamp.cast("timestamp"), "batch_id": F.lit(batch_id).cast("bigint")}
    ).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_LOG.fields])
