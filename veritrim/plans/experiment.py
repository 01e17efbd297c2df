"""An evaluation run: samples in, scored rows of the results log out, resumable."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrim.functions.metrics import entailment_support
from veritrim.functions.prompts import build_prompt, compression_decision, fit_to_window, model_cap, premise, premise_beside
from veritrim.functions.text import strip
from veritrim.functions.vectors import response_consistency
from veritrim.operators.aggregates import experiment_summary, run_counters
from veritrim.operators.compress import compress_to_budget, token_frequencies
from veritrim.operators.grid import condition_grid, pending_cells, skipped_cells
from veritrim.operators.inference import Loader, Packing, Predictor, score_batches
from veritrim.operators.pairing import delta_stats, paired_delta
from veritrim.operators.prepare import sample_defaults
from veritrim.operators.results import (
    any_response,
    main_answer,
    measured,
    no_support,
    result_rows,
    tokens_sent,
    with_sentinels,
)
from veritrim.schemas import Settings
from veritrim.session import written
from veritrim.sources import commits
from veritrim.sources.readers import logged_cells_of
from veritrim.sources.writers import append_results


@dataclass(frozen=True)
class Generation:
    """What a run asks of a model: so many answers a prompt, sampled only if there are several, of so many tokens."""

    answers: int
    sampled: bool
    max_new_tokens: int


@dataclass(frozen=True)
class Compression:
    """What a run asks of a compressor: prompts of so many tokens."""

    target_tokens: int


@dataclass(frozen=True)
class Scorers:
    """The models of a run.

    ``generate(model_name)`` loads a model that maps prompts to lists of answers; a loader with a second parameter
    gets the ``Generation`` of the run. ``compress`` loads a compressor that maps prompts to shorter ones; a loader with a
    second parameter gets the ``Compression`` of the run. When it cannot be loaded, prompts go as they are. Without it the rarest tokens are kept. ``embed`` and
    ``entail``, where given, load models that map answers to vectors and (premise, answer)
    pairs to class logits; without them the column functions are used.
    """

    generate: Loader | Callable[[str, Generation], Predictor]
    compress: Loader | Callable[[None, Compression], Predictor] | None = None
    embed: Loader | None = None
    entail: Loader | None = None
    consistency: Callable[[Column], Column] = any_response
    support: Callable[[Column, Column], Column] = no_support


def plan_cells(
    samples: DataFrame,
    log: DataFrame,
    settings: Settings = Settings(),
    frequencies: DataFrame | None = None,
    scratch: str | None = None,
    compressor: Callable | None = None,
) -> DataFrame:
    """One row per cell still to do, with the prompt to send. The question goes on in the prompt only.

    Only distinct keys meet ``log``, which needs the columns of a cell and nothing else; each sample with work left carries its list of conditions (no more
    than the run has) until its prompt is built and compressed, once for all conditions. Token rarity is that
    of all the samples, done or not, so a resumed run compresses as an uninterrupted one would; samples
    that come in batches need the ``frequencies`` of their corpus for that. ``scratch`` names the
    intermediate table of prompts.
    """
    key = ["id", "dataset"]
    usable = sample_defaults(samples)
    todo = (
        pending_cells(condition_grid(usable.select(*key).distinct(), settings), log)
        .groupBy(*key)
        .agg(F.collect_set(F.struct("model_name", "requested_mode")).alias("_cells"))
    )
    if settings.compression_enabled:
        # Its size is known then, so that no text is shuffled for a few cells, or none.
        todo = written(todo, "todo", scratch)
    # Samples that share a key are one cell: one of them stands for all, the same one in every attempt.
    # Only samples with work left move their texts.
    open_ = usable.join(todo.select(*key), key, "left_semi")
    unique = open_.groupBy(*key).agg(F.min(F.struct("context", "question", "answer")).alias("_s"))
    prompts = unique.join(todo, key).select(
        *key, "_cells", "_s.context", "_s.answer", build_prompt(F.col("_s.context"), F.col("_s.question")).alias("prompt")
    )
    if not settings.compression_enabled:
        counted = prompts.withColumn("orig_tokens", settings.count_tokens(F.col("prompt")))
        return counted.select(
            *key, "context", "answer", "prompt", "orig_tokens",
            F.col("orig_tokens").alias("compressed_tokens"), F.lit(0).alias("compressed"), F.inline("_cells"),
        )
    if compressor is not None:
        wanted = _asked(compressor, Compression(settings.compression_threshold))
        # A prompt is compressed once for all conditions, in tasks dealt by the prompts themselves.
        dealt = prompts.repartition(2 * prompts.sparkSession.sparkContext.defaultParallelism, F.xxhash64("prompt"))
        made = score_batches(dealt, wanted, "prompt", "_short", T.StringType())
        made = made.withColumn("_available", F.col("error").isNull() & F.col("_short").isNotNull()).drop("error")
    else:
        # A stored number is a narrow key for the tokens.
        prompts = written(prompts.withColumn("_number", F.monotonically_increasing_id()), "prompts", scratch)
        if frequencies is None:
            whole = usable.select(build_prompt(F.col("context"), F.col("question")).alias("prompt"))
            frequencies = written(token_frequencies(whole, "prompt", settings.split), "frequencies", scratch)
        short = compress_to_budget(
            prompts, ["_number"], "prompt", settings.compression_threshold, frequencies, split=settings.split, rebuild=settings.rebuild
        ).select("_number", F.col("prompt").alias("_short"))
        made = prompts.join(short, "_number").withColumn("_available", F.lit(True))
    counted = made.withColumns(
        {
            "orig_tokens": settings.count_tokens(F.col("prompt")),
            "_short_tokens": settings.count_tokens(F.col("_short")),
        }
    )
    decided = counted.withColumn(
        "_d",
        compression_decision(
            F.col("prompt"), F.col("orig_tokens"), F.col("_short"), F.col("_short_tokens"), F.col("_available"), settings
        ),
    )
    cells = decided.select(
        *key, "context", "answer", "prompt", "orig_tokens", "_d", F.inline("_cells")
    )
    wanted = F.col("requested_mode") == 1
    return cells.withColumns(
        {
            "prompt": F.when(wanted, F.col("_d.prompt")).otherwise(F.col("prompt")),
            "orig_tokens": F.when(wanted, F.col("_d.orig_tokens")).otherwise(F.col("orig_tokens")),
            "compressed_tokens": F.when(wanted, F.col("_d.compressed_tokens")).otherwise(F.col("orig_tokens")),
            "compressed": F.when(wanted, F.col("_d.was_compressed").cast("int")).otherwise(F.lit(0)),
        }
    ).drop("_d")


def _asked(load: Callable, wanted: Generation | Compression) -> Loader:
    """The loader as Spark's model stage calls it: by model name alone."""
    return load if len(inspect.signature(load).parameters) < 2 else lambda model: load(model, wanted)


def generate(cells: DataFrame, load: Loader, settings: Settings = Settings()) -> DataFrame:
    """Adds ``responses``, stripped, no more than the run asks for.

    Prompts are cut to the input window of their model first; out-of-memory rows are retried once with a shortened prompt.
    """
    wanted = Generation(settings.responses_per_cell, settings.responses_per_cell > 1, settings.max_new_tokens)
    fitted = cells.withColumn("prompt", fit_to_window(F.col("prompt"), model_cap(F.col("model_name"), settings), settings)["prompt"])
    answered = score_batches(
        fitted.withColumn("_sent", F.xxhash64("prompt")),
        _asked(load, wanted),
        "prompt",
        "responses",
        T.ArrayType(T.StringType()),
        model_col="model_name",
        shorten=settings.shorten(settings.retry_tokens),
        packing=Packing(settings.batch_tokens, settings.length, once=not wanted.sampled) if settings.batch_tokens else None,
    )
    answers = F.transform(F.slice("responses", 1, settings.responses_per_cell), strip)
    return (
        answered.withColumn("responses", answers)
        .withColumn("compressed_tokens", tokens_sent(F.col("_sent"), settings))
        .drop("_sent")
    )


def score_cells(cells: DataFrame, scorers: Scorers, settings: Settings = Settings()) -> DataFrame:
    """Metrics for cells that have responses."""
    answer = main_answer(F.col("responses"))
    checked = premise(F.col("context"), F.col("prompt"), settings)
    support, consistency = scorers.support(checked, answer), scorers.consistency(F.col("responses"))
    if scorers.entail is not None:
        pairs = cells.withColumns({"_premise": premise_beside(checked, answer, settings), "_answer": answer})
        cells = score_batches(pairs, scorers.entail, ["_premise", "_answer"], "_logits", T.ArrayType(T.DoubleType()))
        support = entailment_support(F.col("_premise"), F.col("_answer"), F.col("_logits"))
    if scorers.embed is not None:
        cells = score_batches(
            cells, scorers.embed, "responses", "_vectors", T.ArrayType(T.ArrayType(T.FloatType()))
        )
        consistency = response_consistency(F.col("_vectors"))
    return with_sentinels(measured(cells, support, consistency, settings), settings)


def run_batch(
    samples: DataFrame,
    log_path: str,
    scorers: Scorers,
    run_id: str,
    started: datetime,
    settings: Settings = Settings(),
    batch_id: int = 0,
    frequencies: DataFrame | None = None,
) -> None:
    """Score what the log lacks and append it.

    Rows are found by key in the log's index, so a batch that is run again after a lost driver adds only what is missing,
    and no batch reads the log itself. A batch is appended as a whole or not at all; of two writers that began at the same version
    of the log, one fails (``ConcurrentCommit``) and may run its batch again.
    """
    spark = samples.sparkSession
    scratch = hashlib.sha256(log_path.encode()).hexdigest()[:16]
    state = commits.state(spark, log_path)
    known = logged_cells_of(spark, log_path, sample_defaults(samples).select("id", "dataset"), state)
    cells = plan_cells(samples, known, settings, frequencies, scratch, scorers.compress)
    scored = score_cells(generate(cells, scorers.generate, settings), scorers, settings)
    append_results(result_rows(scored, run_id, F.lit(started), batch_id), log_path, run_id, batch_id, state)


def batch_counters(
    samples: DataFrame, log: DataFrame, run_id: str, batch_id: int = 0, settings: Settings = Settings()
) -> DataFrame:
    """Written, skipped and failed rows of a batch of a run, counted from the log it was written to.

    Counting what was committed is exact; accumulators would count retried tasks twice.
    """
    grid = condition_grid(sample_defaults(samples).select("id", "dataset").distinct(), settings)
    own = (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
    return run_counters(log.filter(own), skipped_cells(grid, log.filter(~F.coalesce(own, F.lit(False)))))


def run_report(log: DataFrame) -> dict[str, DataFrame]:
    """Delta statistics over exact pairs and the experiment summary over all rows."""
    return {"delta_stats": delta_stats(paired_delta(log)), "experiment_summary": experiment_summary(log)}
