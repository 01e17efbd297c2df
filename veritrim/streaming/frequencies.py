"""Token frequencies that grow with a stream."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrim.functions.text import tokens
from veritrim.operators.compress import token_frequencies
from veritrim.operators.key_index import to_merge
from veritrim.sources import commits


def _read(spark: SparkSession, path: str, entries: list[dict[str, Any]], schema: T.StructType) -> DataFrame:
    files = [f"{path}/{f['file']}" for e in entries for f in e["files"]]
    parts = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return parts.groupBy("token").agg(F.sum("freq").alias("freq"))


def growing_frequencies(
    texts: DataFrame,
    text_col: str,
    path: str,
    source: str,
    batch_id: int,
    split: Callable[[Column], Column] = tokens,
) -> DataFrame:
    """(token, freq) over all batches so far, this one included.

    Each batch adds the counts of its own texts; earlier ones are not counted again but read as counts, a few tables of them,
    since small ones are merged into larger ones. A batch of a ``source`` (a stream's checkpoint) that is repeated
    after a failure is counted once. Batches are published like those of the log, so a killed one leaves nothing that is read.
    """
    spark, path = texts.sparkSession, path.rstrip("/")
    state = commits.state(spark, path)
    done = state["table"].get("done", {})
    counts = token_frequencies(texts, text_col, split)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in counts.schema.fields])
    if batch_id > done.get(source, -1):
        name = commits.new_name()
        counts.write.parquet(f"{path}/commit={name}")
        added = spark.read.schema(schema).parquet(f"{path}/commit={name}").count()
        taken = to_merge(state["entries"], added)
        kept, merged = state["entries"][: len(state["entries"]) - taken], state["entries"][len(state["entries"]) - taken :]
        if merged:
            own = {"files": commits.data_files(spark, path, f"commit={name}")}
            name = commits.new_name()
            _read(spark, path, [*merged, own], schema).write.parquet(f"{path}/commit={name}")
            added = spark.read.schema(schema).parquet(f"{path}/commit={name}").count()
        entry = {"cells": added, "files": commits.data_files(spark, path, f"commit={name}")}
        commits.publish(spark, path, entry, state, {"done": {**done, source: batch_id}}, kept)
        state = commits.state(spark, path)
    return _read(spark, path, state["entries"], schema)
