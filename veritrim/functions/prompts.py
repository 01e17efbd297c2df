"""Prompt building, input windows and premises."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritrim.functions.text import is_blank
from veritrim.schemas import PROMPT_TAIL, Settings


def build_prompt(context: Column, question: Column) -> Column:
    """Question prompt, preceded by the context when there is one."""
    ask = F.concat(F.lit("Question: "), question, F.lit(PROMPT_TAIL))
    return F.when(
        ~is_blank(context), F.concat(F.lit("Context:\n"), context, F.lit("\n\n"), ask)
    ).otherwise(ask)


def input_cap(model_window: Column, tokenizer_window: Column, settings: Settings = Settings()) -> Column:
    """Most prompt tokens that leave room for the answer.

    A missing, zero or absurdly large window falls back to the default one.
    """
    window = F.coalesce(model_window, tokenizer_window, F.lit(0))
    usable = F.when((window == 0) | (window > settings.window_ceiling), settings.default_window).otherwise(window)
    return F.greatest(F.lit(1), (usable - settings.max_new_tokens - settings.window_reserve).cast("int"))


def model_cap(model: Column, settings: Settings = Settings()) -> Column:
    """``input_cap`` of the model named, by the windows of the run: the model's own, else its tokenizer's."""

    def window(sizes: Mapping[str, int]) -> Column:
        found = F.lit(None).cast("int")
        for name, size in sizes.items():
            found = F.when(model == name, F.lit(size)).otherwise(found)
        return found

    return input_cap(window(settings.windows), window(settings.tokenizer_windows), settings)


def fit_to_window(prompt: Column, cap: Column, settings: Settings = Settings()) -> Column:
    """Struct ``(prompt, tokens, truncated)``; a prompt that fills the window counts as truncated."""
    if settings.fit is not None:
        return settings.fit(prompt, cap)
    count = F.least(settings.count_tokens(prompt), cap)
    return F.struct(
        settings.truncate(prompt, cap).alias("prompt"),
        count.alias("tokens"),
        (count >= cap).alias("truncated"),
    )


def premise(context: Column, prompt: Column, settings: Settings = Settings()) -> Column:
    """Text the answer is checked against: the context, or the prompt when there is none."""
    chosen = F.when(is_blank(context), prompt).otherwise(context)
    return settings.truncate(chosen, settings.premise_tokens)


def premise_beside(premise: Column, answer: Column, settings: Settings = Settings()) -> Column:
    """The premise, cut so that the pair fits ``pair_tokens``; the answer is never cut."""
    room = F.greatest(F.lit(0), F.lit(settings.pair_tokens) - settings.count_tokens(F.coalesce(answer, F.lit(""))))
    return settings.truncate(premise, room.cast("int"))


def compression_decision(
    prompt: Column,
    tokens: Column,
    compressed_prompt: Column,
    compressed_tokens: Column,
    available: Column | bool = True,
    settings: Settings = Settings(),
) -> Column:
    """Struct ``(prompt, orig_tokens, compressed_tokens, was_compressed)``.

    No compressor: the prompt as it is with zero counts. Not forced and within the
    threshold: the prompt as it is. Otherwise the compressed prompt.
    """

    def outcome(text: Column, before: Column, after: Column, done: bool) -> Column:
        return F.struct(
            text.alias("prompt"),
            before.cast("int").alias("orig_tokens"),
            after.cast("int").alias("compressed_tokens"),
            F.lit(done).alias("was_compressed"),
        )

    short = (tokens <= settings.compression_threshold) & F.lit(not settings.force_compression)
    return (
        F.when(~F.lit(available), outcome(prompt, F.lit(0), F.lit(0), False))
        .when(short, outcome(prompt, tokens, tokens, False))
        .otherwise(outcome(compressed_prompt, tokens, compressed_tokens, True))
    )
