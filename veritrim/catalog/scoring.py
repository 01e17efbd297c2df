"""The condition grid, resumption, batch scoring and streaming over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.catalog.base import Query, arriving, log_of, over_log, table
from veritrim.catalog.grouped import SUMMARY_SQL
from veritrim.catalog.preparation import DIALOGUE_SQL
from veritrim.catalog.prompts import (
    PROMPT_SQL,
    compress_sql,
    exact_match_sql,
    keyword_match_sql,
    truncated_sql,
    words_sql,
)
from veritrim.functions.metrics import error_text
from veritrim.functions.prompts import build_prompt
from veritrim.functions.text import first_words
from veritrim.operators.aggregates import run_counters
from veritrim.operators.compress import token_frequencies
from veritrim.operators.grid import condition_grid, pending_cells, skipped_cells
from veritrim.operators.prepare import dialogue_samples
from veritrim.operators.results import any_response, full_support, measured, result_rows
from veritrim.plans.experiment import Generation, Scorers, batch_counters, generate, plan_cells, run_batch, score_cells
from veritrim.plans.results_log import results_log
from veritrim.schemas import MODELS, RESULT_LOG, Settings
from veritrim.session import shared_folder, ship_package, written
from veritrim.sources.readers import no_rows, read_log
from veritrim.streaming.jobs import read_summary, score_stream, summary_stream

RUN_ID = "20240101_000000"
STARTED = datetime(2024, 1, 1)
SHORT = Settings(compression_threshold=64)
PLAIN = Settings(compression_enabled=False, retry_tokens=150)
STREAMED = Settings(models=(MODELS[0], MODELS[3]), compression_threshold=64, retry_tokens=150)
ROOM = 200


def load_stub(model_name: str) -> Callable[[list[str]], list]:
    """A deterministic model: answers with words of the prompt, and fails in each of the ways a model can."""
    if "Mistral" in model_name:
        raise OSError("weights not found")

    def answer(prompt: str):
        words = prompt.split()
        if len(words) > ROOM:
            return RuntimeError("CUDA out of memory")
        if "Llama-2" in model_name and words[0] == "Context:":
            return ValueError(f"cannot read {words[1]}")
        return [f"{words[1]} {words[-1]}", words[1]]

    return lambda prompts: [answer(p) for p in prompts]


STUBS = Scorers(generate=load_stub, consistency=any_response, support=full_support)


FULL = Settings(
    models=(MODELS[0], MODELS[3]), compression_threshold=48, responses_per_cell=2, windows={MODELS[0]: 100 + 64 + 8}
)


def load_speaker(model_name: str, wanted: Generation) -> Callable[[list[str]], list]:
    """A deterministic model with as many answers as the run asks for, in white space."""

    def answers(prompt: str) -> list[str]:
        words = prompt.split()
        return [f"  {words[1]} {words[-1]}\n", words[1], words[0]][: wanted.answers]

    return lambda prompts: [answers(p) for p in prompts]


def load_cutter(_: None) -> Callable[[list[str]], list[str]]:
    """A compressor that keeps the first words."""
    return lambda prompts: [first_words(FULL.compression_threshold)(p) for p in prompts]


def load_embedder(_: None) -> Callable[[list[list[str]]], list]:
    """Short answers point one way, long ones another."""
    return lambda rows: [[[1.0, 0.0] if len(a) <= 6 else [0.0, 1.0] for a in answers] for answers in rows]


def load_judge(_: None) -> Callable[[list[tuple[str, str]]], list]:
    """Entailment by the length of the premise."""
    return lambda pairs: [[0.0, 0.0, 2.0 if len(premise) % 2 else 0.0] for premise, _ in pairs]


def _full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run with every stage: compressor, windows, several answers, embeddings and entailment."""
    ship_package(spark)
    samples = dialogue_samples(table(spark, sf_dir, "conversations"))
    log_path = shared_folder(spark, "full-run")
    scorers = Scorers(generate=load_speaker, compress=load_cutter, embed=load_embedder, entail=load_judge)
    run_batch(samples, log_path, scorers, RUN_ID, STARTED, FULL)
    return read_log(spark, log_path).drop("timestamp", "batch_id")


def _batch_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each of two runs over a log; odd events are the second run, and batch numbers are the same."""
    log = log_of(spark, sf_dir).withColumns(
        {"run_id": F.when(F.col("event_id") % 2 == 0, "first").otherwise("second"), "batch_id": F.lit(0)}
    )
    samples = grid_samples(spark, sf_dir)
    counted = [
        batch_counters(samples.withColumns({c: F.lit("") for c in ("context", "question", "answer")}), log, run).withColumn(
            "run_id", F.lit(run)
        )
        for run in ("first", "second")
    ]
    return counted[0].unionByName(counted[1])


def grid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that occur in the log, to be run with the models of a run."""
    return log_of(spark, sf_dir).select("id", "dataset").distinct()


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type error stand for rows that failed."""
    failed = F.col("model_name").contains("Tiny")
    log = log_of(spark, sf_dir)
    marked = log.withColumn(
        "prediction", F.when(failed, error_text(F.lit("ValueError"), F.col("prediction"))).otherwise(F.col("prediction"))
    )
    grid = condition_grid(grid_samples(spark, sf_dir))
    return run_counters(marked, skipped_cells(grid, log))


def _score_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue sample under every condition; responses come from columns, not from a model."""
    samples = dialogue_samples(table(spark, sf_dir, "conversations"))
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), SHORT)
    spoken = F.concat(F.lit("  "), F.col("answer"), F.lit("!"))
    answered = cells.withColumn(
        "responses",
        F.when(F.col("requested_mode") == 0, F.array(spoken, F.col("prompt"))).otherwise(F.array("prompt")),
    )
    scored = measured(answered, F.lit(1.0), any_response(F.col("responses")), SHORT)
    return result_rows(scored, RUN_ID, F.lit(STARTED)).drop("timestamp", "batch_id")


def _batch_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    samples = dialogue_samples(table(spark, sf_dir, "conversations"))
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), PLAIN)
    scored = score_cells(generate(cells, load_stub, PLAIN), STUBS, PLAIN)
    return result_rows(scored, RUN_ID, F.lit(STARTED)).drop("timestamp", "batch_id")


def _as_samples(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("dataset"),
        F.lit("").alias("context"),
        F.col("text").alias("question"),
        F.col("lang").alias("answer"),
    )


def _resumable_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive as samples and are scored into a new log; the second run finds nothing left to do."""
    ship_package(spark)
    folder = shared_folder(spark, "scoring")
    log_path = f"{folder}/log"
    samples = _as_samples(arriving(spark, sf_dir, "documents"))
    corpus = _as_samples(table(spark, sf_dir, "documents"))
    prompts = corpus.select(build_prompt(F.col("context"), F.col("question")).alias("prompt"))
    frequencies = written(token_frequencies(prompts, "prompt"), "frequencies")
    for attempt in ("first", "second"):
        score_stream(
            samples, log_path, f"{folder}/{attempt}", STUBS, RUN_ID, STARTED, STREAMED, frequencies
        ).awaitTermination()
    return read_log(spark, log_path).select(
        "id", "dataset", "model_name", "requested_mode", "orig_tokens", "compressed_tokens", "prediction", "exact_match"
    )


def _running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The state is a few rows, so a session of its own with few shuffle partitions keeps few state files.
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    folder = shared_folder(spark, "summary")
    log = results_log(arriving(session, sf_dir, "events"))
    summary_stream(log, f"{folder}/summary", f"{folder}/checkpoint").awaitTermination()
    return read_summary(spark, f"{folder}/summary")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condition_grid(table(spark, sf_dir, "benchmark").select("item_id"))


QUERIES: dict[str, Query] = {
    "condition_grid": _grid,
    "pending_cells": lambda s, d: pending_cells(condition_grid(grid_samples(s, d)), log_of(s, d)),
    "skipped_cells": lambda s, d: skipped_cells(condition_grid(grid_samples(s, d)), log_of(s, d)),
    "run_counters": _counters,
    "score_results": _score_results,
    "batch_scoring": _batch_scoring,
    "full_run": _full_run,
    "batch_counters": _batch_counters,
    "resumable_scoring": _resumable_scoring,
    "running_summary": lambda s, d: _running_summary(s, d),
}


def _models_sql(models: tuple[str, ...]) -> str:
    names = ", ".join(f"('{m}')" for m in models)
    return f"models(model_name) AS (VALUES {names})"


_GRID = f"""{_models_sql(MODELS)}, modes(requested_mode) AS (VALUES (0), (1)),
grid AS (
  SELECT id, dataset, model_name, requested_mode FROM (SELECT DISTINCT id, dataset FROM results_log), models, modes
), done AS (SELECT DISTINCT id, dataset, model_name, compressed AS requested_mode FROM results_log)"""

# What the stub does with a prompt: shorten it when it is too long, then answer with its second and last words.
_STUB = f"""
sized AS (SELECT *, len({words_sql('prompt')}) AS n FROM cells),
sent AS (SELECT *, {words_sql("CASE WHEN n > 200 THEN " + truncated_sql('prompt', '150') + " ELSE prompt END")} AS w FROM sized),
answered AS (
  SELECT *, model_name LIKE '%Llama-2%' AND w[1] = 'Context:' AS failed, w[2] || ' ' || w[-1] AS said FROM sent
)"""

ORACLES: dict[str, str] = {
    "condition_grid": f"""WITH {_models_sql(MODELS)}, modes(requested_mode) AS (VALUES (0), (1))
        SELECT item_id, model_name, requested_mode FROM benchmark, models, modes""",
    "pending_cells": over_log(
        f", {_GRID} SELECT * FROM grid ANTI JOIN done USING (id, dataset, model_name, requested_mode)"
    ),
    "skipped_cells": over_log(
        f", {_GRID} SELECT * FROM grid SEMI JOIN done USING (id, dataset, model_name, requested_mode)"
    ),
    "run_counters": over_log(
        f""", {_GRID} SELECT CAST(count(*) AS BIGINT) AS written,
        (SELECT CAST(count(*) AS BIGINT) FROM grid SEMI JOIN done USING (id, dataset, model_name, requested_mode)) AS skipped,
        CAST(count(*) FILTER (model_name LIKE '%Tiny%') AS BIGINT) AS errors FROM results_log"""
    ),
    "score_results": f"""WITH {DIALOGUE_SQL}, prompted AS (SELECT *, {PROMPT_SQL} AS whole_prompt FROM samples),
        {compress_sql('prompted', 'id', 'whole_prompt', 64)}, {_models_sql(MODELS)}, modes(requested_mode) AS (VALUES (0), (1)),
        cells AS (
          SELECT id, dataset, model_name, requested_mode, orig_tokens, answer,
            CASE WHEN requested_mode = 1 THEN compressed_tokens ELSE orig_tokens END AS compressed_tokens,
            CASE WHEN requested_mode = 1 THEN short.prompt ELSE '  ' || answer || '!' END AS prediction
          FROM prompted JOIN short USING (id), models, modes)
        SELECT id, dataset, model_name, requested_mode AS compressed, orig_tokens, compressed_tokens, prediction,
          {exact_match_sql('prediction', 'answer')} AS exact_match, {keyword_match_sql('prediction', 'answer')} AS keyword_match,
          1.0e0 AS self_consistency, 1.0e0 AS nli_support, 0.0e0 AS hallucination, '{RUN_ID}' AS run_id, requested_mode
        FROM cells""",
    "batch_scoring": f"""WITH {DIALOGUE_SQL}, {_models_sql(MODELS)}, cells AS (
          SELECT *, {PROMPT_SQL} AS prompt FROM samples, models WHERE model_name NOT LIKE '%Mistral%'), {_STUB},
        predicted AS (
          SELECT *, CASE WHEN failed THEN '[SKIPPED_ERROR] ValueError: cannot read ' || w[2] ELSE said END AS prediction
          FROM answered)
        SELECT id, dataset, model_name, 0 AS compressed, CAST(n AS INTEGER) AS orig_tokens,
          CAST(len(w) AS INTEGER) AS compressed_tokens, prediction,
          CASE WHEN failed THEN 0.0e0 ELSE {exact_match_sql('prediction', 'answer')} END AS exact_match,
          CASE WHEN failed THEN 0.0e0 ELSE {keyword_match_sql('prediction', 'answer')} END AS keyword_match,
          CASE WHEN failed THEN 0.0e0 ELSE 1.0e0 END AS self_consistency,
          CASE WHEN failed THEN 0.0e0 ELSE 1.0e0 END AS nli_support,
          CASE WHEN failed THEN 1.0e0 ELSE 0.0e0 END AS hallucination, '{RUN_ID}' AS run_id, 0 AS requested_mode
        FROM predicted""",
    "full_run": f"""WITH {DIALOGUE_SQL}, {_models_sql(FULL.models)}, modes(requested_mode) AS (VALUES (0), (1)),
        prompted AS (SELECT *, {PROMPT_SQL} AS whole FROM samples),
        cells AS (
          SELECT *, CAST(len({words_sql('whole')}) AS INTEGER) AS n,
            CASE WHEN requested_mode = 1 THEN {truncated_sql('whole', '48')} ELSE whole END AS asked,
            CASE WHEN model_name = '{FULL.models[0]}' THEN 100 ELSE 4096 - 64 - 8 END AS cap
          FROM prompted, models, modes),
        sent AS (SELECT *, {truncated_sql('asked', 'cap')} AS prompt FROM cells),
        said AS (SELECT *, {words_sql('prompt')} AS w FROM sent),
        answered AS (
          SELECT *, w[2] || ' ' || w[-1] AS prediction, CASE WHEN trim(context) <> '' THEN context ELSE prompt END AS long_premise
          FROM said),
        cut AS (SELECT *, {truncated_sql('long_premise', '400')} AS short_premise, 512 - len({words_sql('prediction')}) AS room
          FROM answered),
        judged AS (SELECT *, {truncated_sql('short_premise', 'room')} AS premise FROM cut),
        scored AS (
          SELECT *, CASE WHEN premise = '' OR prediction = '' THEN 0.0e0 WHEN length(premise) % 2 = 1
            THEN exp(0.0e0) / (exp(-2.0e0) + exp(-2.0e0) + exp(0.0e0)) ELSE 1.0e0 / 3 END AS nli_support FROM judged)
        SELECT id, dataset, model_name, requested_mode AS compressed, n AS orig_tokens,
          CAST(len({words_sql('asked')}) AS INTEGER) AS compressed_tokens, prediction,
          {exact_match_sql('prediction', 'answer')} AS exact_match, {keyword_match_sql('prediction', 'answer')} AS keyword_match,
          CASE WHEN (length(prediction) <= 6) = (length(w[2]) <= 6) THEN 1.0e0 ELSE 0.0e0 END AS self_consistency, nli_support,
          CASE WHEN nli_support < 0.5 THEN 1.0e0 ELSE 0.0e0 END AS hallucination, '{RUN_ID}' AS run_id, requested_mode
        FROM scored""",
    "batch_counters": over_log(
        f""", {_models_sql(MODELS)}, modes(requested_mode) AS (VALUES (0), (1)), runs(run, own) AS (VALUES ('first', 0), ('second', 1)),
        grid AS (
          SELECT id, dataset, model_name, requested_mode FROM (SELECT DISTINCT id, dataset FROM results_log), models, modes),
        done AS (SELECT DISTINCT event_id % 2 AS own, id, dataset, model_name, compressed AS requested_mode FROM results_log)
        SELECT (SELECT CAST(count(*) AS BIGINT) FROM results_log WHERE event_id % 2 = own) AS written,
          (SELECT CAST(count(*) AS BIGINT) FROM grid JOIN done USING (id, dataset, model_name, requested_mode)
            WHERE done.own <> runs.own) AS skipped, CAST(0 AS BIGINT) AS errors, run AS run_id FROM runs"""
    ),
    "resumable_scoring": f"""WITH samples AS (
          SELECT CAST(doc_id AS VARCHAR) AS id, source AS dataset, '' AS context, text AS question, lang AS answer FROM documents),
        prompted AS (SELECT *, {PROMPT_SQL} AS whole_prompt FROM samples), {compress_sql('prompted', 'id', 'whole_prompt', 64)},
        {_models_sql(STREAMED.models)}, modes(requested_mode) AS (VALUES (0), (1)),
        cells AS (
          SELECT prompted.id, dataset, model_name, requested_mode, answer, orig_tokens,
            CASE WHEN requested_mode = 1 THEN short.prompt ELSE whole_prompt END AS prompt
          FROM prompted JOIN short USING (id), models, modes), {_STUB}
        SELECT id, dataset, model_name, requested_mode, orig_tokens,
          CAST(len(w) AS INTEGER) AS compressed_tokens, said AS prediction, {exact_match_sql('said', 'answer')} AS exact_match
        FROM answered""",
    "running_summary": SUMMARY_SQL,
}
