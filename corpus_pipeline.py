"""A corpus from raw documents to token files, in stages that each hand on the documents they keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.llm import catalog, decontaminate, jaccard_join, language_id, mixing, simple8b
from veritrim.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Mean probability of the predicted language below which a document is rejected.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und``, and with a score of at least ``LEAST_SCORE``.

    The model learns from the labelled documents at hand. A document without a label gets the predicted one; others
    keep theirs.
    """
    model = language_id.fit(*language_id.sample(docs, F.lit(True)))
    found = language_id.predict(docs, model).filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; of repeated rows, one."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.repeat_by_copies(docs, mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files; returns what they hold of each document."""
    path = simple8b.write_documents(docs, catalog.byte_bpe_path(), end_id=2)
    return simple8b.read_documents(spark, path, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mix_sources),
    ("token_ids", token_ids),
]
#: SQL has no language model, rounding or tokenizer; ``tests/llm`` compares stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
