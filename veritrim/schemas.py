"""Schemas, run settings and the fixed values that results depend on."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from veritrim.functions.text import first_words, hard_truncate, spaced, token_count, tokens

SAMPLE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

RAW_ARITHMETIC = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)

RAW_READING = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField(
            "answers",
            T.StructType([T.StructField("text", T.ArrayType(T.StringType()))]),
        ),
    ]
)

RAW_MULTIHOP = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField(
            "context",
            T.StructType(
                [
                    T.StructField("title", T.ArrayType(T.StringType())),
                    T.StructField("sentences", T.ArrayType(T.ArrayType(T.StringType()))),
                ]
            ),
        ),
    ]
)

RAW_TRIVIA = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StructType([T.StructField("value", T.StringType())])),
        T.StructField(
            "entity_pages",
            T.StructType([T.StructField("wiki_context", T.ArrayType(T.StringType()))]),
        ),
    ]
)

RESULT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("compressed", T.IntegerType()),
        T.StructField("orig_tokens", T.IntegerType()),
        T.StructField("compressed_tokens", T.IntegerType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("exact_match", T.DoubleType()),
        T.StructField("keyword_match", T.DoubleType()),
        T.StructField("self_consistency", T.DoubleType()),
        T.StructField("nli_support", T.DoubleType()),
        T.StructField("hallucination", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

# The log as stored: the mode that was asked for can differ from the mode that
# was applied when no compressor is available, so both are kept.
RESULT_LOG = T.StructType(
    RESULT.fields
    + [
        T.StructField("requested_mode", T.IntegerType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

METRICS = (
    "exact_match",
    "keyword_match",
    "self_consistency",
    "nli_support",
    "hallucination",
)
NUMERIC_COLUMNS = ("compressed", "orig_tokens", "compressed_tokens") + METRICS
REQUIRED_COLUMNS = ("model_name", "dataset", "compressed", "nli_support", "hallucination")

NATURAL_KEY = ("id", "dataset", "model_name", "compressed")
CELL_KEY = ("id", "dataset", "model_name", "requested_mode")
PAIR_KEY = ("id", "dataset", "model_name")

# The models of a run, the label order of the model families,
# and the prompt wording.
MODELS = (
    "microsoft/Phi-3-mini-4k-instruct",
    "mistralai/Mistral-7B-Instruct-v0.2",
    "meta-llama/Llama-2-7b-chat-hf",
    "meta-llama/Meta-Llama-3-8B-Instruct",
)
FAMILY_ORDER = ("Tiny", "Phi", "LLaMA2", "Mistral", "LLaMA3")
PROMPT_TAIL = (
    "\nRespond with ONLY the final answer."
    "\nIf the answer is numeric, output only the number."
    "\nDo not explain."
    "\nAnswer:"
)
# The mark of a failed row, and what runtimes say when memory runs out.
ERROR_MARK = "[SKIPPED_ERROR] "
OOM_MARKERS = (
    "out of memory",
    "cublas_status_alloc_failed",
    "cuda error",
)


@dataclass(frozen=True)
class Settings:
    """Run parameters; the defaults are the published run parameters.

    ``count_tokens`` turns a text column into token counts, ``truncate`` keeps the first tokens of a text column, and
    ``shorten`` does so for one text in a model stage; ``split`` and ``rebuild`` turn a text into tokens and those that compression
    keeps into a text: white-space words, or those of a tokenizer (``functions.tokenizers``). ``batch_tokens``, where given, bounds the padded tokens of a call of a
    model, whose inputs ``length`` measures. ``windows`` has the context window of each model that has another than ``default_window``,
    ``tokenizer_windows`` that of its tokenizer, which counts where the model names none; ``fit`` cuts and counts in one go.
    """

    models: tuple[str, ...] = MODELS
    compression_enabled: bool = True
    force_compression: bool = True
    compression_threshold: int = 2000
    hallucination_threshold: float = 0.5
    max_new_tokens: int = 64
    default_window: int = 4096
    window_ceiling: int = 100_000
    window_reserve: int = 8
    retry_tokens: int = 1024
    premise_tokens: int = 400
    pair_tokens: int = 512
    error_chars: int = 180
    responses_per_cell: int = 1
    batch_tokens: int | None = None
    length: Callable[[str], int] = lambda text: len(text.split())
    windows: Mapping[str, int] = field(default_factory=dict)
    tokenizer_windows: Mapping[str, int] = field(default_factory=dict)
    fit: Callable[[Column, Column | int], Column] | None = None
    count_tokens: Callable[[Column], Column] = token_count
    truncate: Callable[[Column, Column | int], Column] = hard_truncate
    shorten: Callable[[int], Callable[[str], str]] = first_words
    split: Callable[[Column], Column] = tokens
    rebuild: Callable[[Column], Column] = spaced

    @property
    def modes(self) -> tuple[int, ...]:
        return (0, 1) if self.compression_enabled else (0,)
