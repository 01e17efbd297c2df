"""Dataset preparation: raw question-answering rows to samples of one schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrim.functions.text import final_answer, first_or_empty, flatten_context
from veritrim.operators.numbering import number_capped, number_sorted
from veritrim.operators.skew import first_n_per_group, lookup_join
from veritrim.schemas import SAMPLE


def unify(df: DataFrame, context: Column, question: Column, answer: Column, dataset: Column, id_: Column) -> DataFrame:
    """Projection to the sample schema."""
    return df.select(
        id_.alias("id"), dataset.alias("dataset"), context.alias("context"), question.alias("question"),
        answer.alias("answer"),
    )


def _capped_samples(df: DataFrame, dataset: str, prefix: str, order: Sequence[Column], n: int | None) -> DataFrame:
    """All rows, or the first ``n`` where given, in the given order, numbered 1, 2, 3, … without gaps."""
    named = df.withColumn("dataset", F.lit(dataset))
    if n is None:
        return number_sorted(named, order, F.lit(f"{prefix}_")).select(*SAMPLE.names)
    capped = first_n_per_group(named, ["dataset"], order, n)
    return number_capped(capped, "dataset", order, F.lit(f"{prefix}_")).select(*SAMPLE.names)


def arithmetic_samples(raw: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Answer is what follows the last ``####``; there is no context."""
    rows = raw.withColumns({"context": F.lit(""), "answer": final_answer(F.col("answer"))})
    return _capped_samples(rows, "gsm8k", "gsm8k", order, n)


def with_first_answer(raw: DataFrame, answers: str) -> DataFrame:
    """Drop rows with an empty answer array and keep the first answer of the others."""
    return raw.filter(F.size(answers) > 0).withColumn("answer", F.element_at(answers, 1))


def reading_samples(raw: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Answerable questions only, with their first answer."""
    return _capped_samples(with_first_answer(raw, "answers.text"), "squad_v2", "squad", order, n)


def multihop_samples(raw: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Context is all titled paragraphs in one text."""
    rows = raw.withColumn("context", flatten_context(F.col("context.title"), F.col("context.sentences")))
    return _capped_samples(rows, "hotpot_qa", "hotpot", order, n)


def trivia_samples(raw: DataFrame, order: Sequence[Column], n: int | None = None) -> DataFrame:
    """Context is the first page text, or empty."""
    rows = raw.withColumns(
        {"context": first_or_empty(F.col("entity_pages.wiki_context")), "answer": F.col("answer.value")}
    )
    return _capped_samples(rows, "trivia_qa", "trivia", order, n)


def sample_defaults(samples: DataFrame) -> DataFrame:
    """Missing dataset, context and answer get their defaults; rows without id or question are left out."""
    return samples.filter(F.col("id").isNotNull() & F.col("question").isNotNull()).withColumns(
        {
            "dataset": F.coalesce("dataset", F.lit("unknown")),
            "context": F.coalesce("context", F.lit("")),
            "answer": F.coalesce("answer", F.lit("")),
        }
    )


def sample_rejects(samples: DataFrame) -> DataFrame:
    """Rows that ``sample_defaults`` leaves out."""
    return samples.filter(F.col("id").isNull() | F.col("question").isNull())


def dialogue_samples(turns: DataFrame, dataset: str = "dialogue") -> DataFrame:
    """Samples from conversation turns ``(conv_id, turn, role, text)``.

    A user turn is the question, the assistant turn right after it the answer, the first system turn
    of the conversation the context. Answers are found by an equi-join on the turn number, so a
    very long conversation spreads over all partitions.
    """
    asked = turns.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("_next")
    )
    replies = turns.filter(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("_next"), F.col("text").alias("answer")
    )
    contexts = (
        turns.filter(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    )
    framed = lookup_join(asked, contexts, "conv_id", ["context"])
    answered = framed.join(replies, ["conv_id", "_next"], "left")
    empty = F.lit("")
    return unify(
        answered,
        context=F.coalesce("context", empty),
        question=F.col("question"),
        answer=F.coalesce("answer", empty),
        dataset=F.lit(dataset),
        id_=F.concat_ws("_", F.lit("conv"), F.col("conv_id"), F.col("turn")),
    )
