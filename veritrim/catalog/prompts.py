"""Prompts, compression, and text and vector metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrim.catalog.base import Query, table
from veritrim.catalog.preparation import DIALOGUE_SQL
from veritrim.functions.metrics import (
    STOPWORDS,
    entailment_support,
    exact_match,
    is_out_of_memory,
    keyword_match,
)
from veritrim.functions.prompts import build_prompt, compression_decision, fit_to_window, input_cap, premise
from veritrim.functions.text import hard_truncate, last_number, normalize_text, token_count
from veritrim.functions.tokenizers import Pieces, token_fitter, token_joiner, token_splitter
from veritrim.functions.vectors import response_consistency
from veritrim.operators.compress import compress_to_budget
from veritrim.operators.inference import score_batches
from veritrim.operators.prepare import dialogue_samples
from veritrim.operators.results import FAILED, with_sentinels
from veritrim.operators.vectors import self_consistency
from veritrim.schemas import MODELS, Settings
from veritrim.session import ship_package, written

BUDGET = 64
SHORT_RUN = Settings(force_compression=False, compression_threshold=BUDGET)


def prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = dialogue_samples(table(spark, sf_dir, "conversations"))
    return samples.withColumn("prompt", build_prompt(F.col("context"), F.col("question")))


def _input_window(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> DataFrame:
    """Windows of every kind by language: small, ordinary, unknown, absurdly large."""
    lang = F.col("lang")
    model_window = F.when(lang == "en", 600).when(lang == "fr", 2048).when(lang == "es", 200_000)
    tokenizer_window = F.when(lang == "de", 1024)
    fitted = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text"), input_cap(model_window, tokenizer_window).alias("cap")
    )
    return fitted.withColumn("_f", fit_to_window(F.col("text"), F.col("cap"), settings)).select("doc_id", "cap", "_f.*")


def byte_pairs() -> tuple:
    """(encode, decode) of a public tokenizer; its file is found on the worker that loads it."""
    import public_tokenizers

    pieces = Pieces(public_tokenizers.path("byte_bpe_50k.json"), most=400_000)
    return lambda text: pieces.encode([text])[0].tolist(), lambda ids: pieces.tokenizer.decode(ids, skip_special_tokens=False)


def _input_window_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows in the tokens of a subword tokenizer."""
    ship_package(spark)
    return _input_window(spark, sf_dir, Settings(fit=token_fitter(byte_pairs)))


def _token_count_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    fit = token_fitter(byte_pairs)(F.col("text"), 2**31 - 1)
    return table(spark, sf_dir, "documents").select("doc_id", fit["tokens"].alias("tokens"))


def _compress_with_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget, rarity and cut in the tokens of a subword tokenizer."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split, rebuild = token_splitter(byte_pairs), token_joiner(byte_pairs)
    return compress_to_budget(docs, ["doc_id"], "text", BUDGET, split=split, rebuild=rebuild)


def _compression_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with an answer have a compressor; those above the threshold use it."""
    prompts = written(prompted(spark, sf_dir), "prompts")
    short = compress_to_budget(prompts, ["id"], "prompt", BUDGET).withColumnRenamed("prompt", "short")
    decision = compression_decision(
        F.col("prompt"), F.col("orig_tokens"), F.col("short"), F.col("compressed_tokens"),
        available=F.col("answer") != "", settings=SHORT_RUN,
    )
    return prompts.join(short, "id").select("id", decision.alias("_d")).select("id", "_d.*")


def _response_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers a row, embedded in a model stage: the stored vector and the same one turned by a place."""
    ship_package(spark)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    load = lambda _: lambda vectors: [[v, v[1:] + v[:1]] for v in vectors]
    made = score_batches(rows, load, "embedding", "_vectors", T.ArrayType(T.ArrayType(T.FloatType())))
    return made.select("vec_id", response_consistency(F.col("_vectors")).alias("self_consistency"))


def _altered_text() -> Column:
    """A prediction for the text as gold, by language: same words, another number, nothing, other letters."""
    lang, text = F.col("lang"), F.col("text")
    return (
        F.when(lang == "en", F.concat(F.lit("  "), text, F.lit("!")))
        .when(lang == "fr", F.concat(text, F.lit(" 42")))
        .when(lang == "de", F.lit(""))
        .otherwise(F.replace(text, F.lit("e"), F.lit("a")))
    )


def _last_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = (
        table(spark, sf_dir, "documents")
        .select(F.lit("documents").alias("origin"), F.col("doc_id").alias("row_id"), "text")
        .unionByName(
            table(spark, sf_dir, "events").select(
                F.lit("events").alias("origin"), F.col("event_id").alias("row_id"), F.col("props").alias("text")
            )
        )
    )
    return texts.select("origin", "row_id", last_number(F.col("text")).alias("number"))


def _softmax_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third component of a vector adds up to one logit; label 0 has no hypothesis."""

    def logit(c: int) -> Column:
        part = F.filter(F.col("embedding").cast("array<double>"), lambda x, i: i % 3 == c)
        return F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x)

    logits = F.array(logit(0), logit(1), logit(2))
    hypothesis = F.when(F.col("label") == 0, "").otherwise("answer")
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", hypothesis.alias("h"), logits.alias("logits"))
        .select("vec_id", entailment_support(F.lit("premise"), F.col("h"), F.col("logits")).alias("support"))
    )


def _error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, props = F.col("event_type"), F.col("props")
    message = (
        F.when(kind == "error", F.concat(F.lit("CUDA error: "), props))
        .when(kind == "purchase", F.concat(props, F.lit(" CUBLAS_STATUS_ALLOC_FAILED")))
        .when(kind == "click", F.concat(F.lit("Out of Memory, "), props))
        .otherwise(props)
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("events").alias("origin"), F.col("event_id").alias("row_id"), message.alias("message")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("row_id"), F.col("text").alias("message")
    )
    return events.unionByName(documents).select(
        "origin", "row_id", is_out_of_memory(F.col("message")).alias("out_of_memory")
    )


def _sentinel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents fail with their text as message, French ones lack their model."""
    lang = F.col("lang")

    def error(kind: str, message: Column, unavailable: bool) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), message.alias("message"), F.lit(unavailable).alias("unavailable")
        )

    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("dataset"),
        F.lit(MODELS[0]).alias("model_name"),
        F.lit(0).alias("compressed"),
        F.lit(1).alias("requested_mode"),
        F.col("lang").alias("prediction"),
        *[F.lit(0.75).alias(m) for m in FAILED],
        F.when(lang == "en", error("ValueError", F.col("text"), False))
        .when(lang == "fr", error("OSError", F.lit("no weights"), True))
        .alias("error"),
    )
    return with_sentinels(rows).drop("error", "requested_mode")


QUERIES: dict[str, Query] = {
    "build_prompt": lambda s, d: prompted(s, d).select("id", "prompt"),
    "premise_select": lambda s, d: prompted(s, d).select(
        "id", premise(F.col("context"), F.col("prompt")).alias("premise")
    ),
    "token_count": lambda s, d: table(s, d, "documents").select("doc_id", token_count(F.col("text")).alias("tokens")),
    "hard_truncate": lambda s, d: table(s, d, "documents").select(
        "doc_id", hard_truncate(F.col("text"), 1024).alias("prompt")
    ),
    "input_window": _input_window,
    "compress_to_budget": lambda s, d: compress_to_budget(table(s, d, "documents"), ["doc_id"], "text", BUDGET),
    "compression_decision": _compression_decision,
    "error_classify": _error_classify,
    "sentinel_rows": _sentinel_rows,
    "normalize_text": lambda s, d: table(s, d, "documents").select(
        "doc_id", normalize_text(F.col("text")).alias("normalized")
    ),
    "last_number": _last_number,
    "exact_match": lambda s, d: table(s, d, "documents").select(
        "doc_id", exact_match(_altered_text(), F.col("text")).alias("exact_match")
    ),
    "keyword_match": lambda s, d: table(s, d, "documents").select(
        "doc_id", keyword_match(_altered_text(), F.col("text")).alias("keyword_match")
    ),
    "response_embedding": _response_embedding,
    "self_consistency": lambda s, d: self_consistency(table(s, d, "embeddings"), ["label"], "embedding"),
    "softmax_support": lambda s, d: _softmax_support(s, d),
}

TAIL_SQL = (
    "chr(10) || 'Respond with ONLY the final answer.' || chr(10) || "
    "'If the answer is numeric, output only the number.' || chr(10) || 'Do not explain.' || chr(10) || 'Answer:'"
)
PROMPT_SQL = (
    "CASE WHEN trim(context) <> '' THEN 'Context:' || chr(10) || context || chr(10) || chr(10) ELSE '' END "
    f"|| 'Question: ' || question || {TAIL_SQL}"
)


def words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def truncated_sql(text: str, limit: str) -> str:
    words = words_sql(text)
    return f"CASE WHEN len({words}) > {limit} THEN array_to_string(list_slice({words}, 1, {limit}), ' ') ELSE {text} END"


def normalized_sql(text: str) -> str:
    punctuation = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
    return rf"trim(regexp_replace(translate(lower({text}), '{punctuation}', ''), '\s+', ' ', 'g'))"


def last_number_sql(text: str) -> str:
    return rf"regexp_extract_all(replace({text}, ',', ''), '-?\d+\.?\d*')[-1]"


def exact_match_sql(prediction: str, gold: str) -> str:
    return f"""CASE WHEN coalesce({prediction}, '') = '' OR coalesce({gold}, '') = '' THEN 0.0e0
      WHEN {last_number_sql(gold)} IS NOT NULL
        THEN CASE WHEN coalesce({last_number_sql(prediction)} = {last_number_sql(gold)}, false) THEN 1.0e0 ELSE 0.0e0 END
      WHEN {normalized_sql(prediction)} = {normalized_sql(gold)} THEN 1.0e0 ELSE 0.0e0 END"""


def keyword_match_sql(prediction: str, gold: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    wanted = f"list_filter(string_split({normalized_sql(gold)}, ' '), lambda w: w <> '' AND w NOT IN ({stop}))"
    return f"""CASE WHEN coalesce({prediction}, '') = '' OR coalesce({gold}, '') = '' OR len({wanted}) = 0 THEN 0.0e0
      WHEN list_has_all(string_split({normalized_sql(prediction)}, ' '), {wanted}) THEN 1.0e0 ELSE 0.0e0 END"""


def compress_sql(source: str, key: str, text: str, budget: int) -> str:
    """CTEs ending in ``short(key, prompt, orig_tokens, compressed_tokens)``."""
    return f"""
words AS (SELECT {key}, {text} AS whole, {words_sql(text)} AS ws FROM {source}),
placed AS (SELECT {key}, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM words),
freqs AS (SELECT token, count(*) AS freq FROM placed GROUP BY token),
kept AS (
  SELECT {key}, token, pos FROM placed JOIN freqs USING (token)
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY freq, pos) <= {budget}
),
joined AS (SELECT {key}, string_agg(token, ' ' ORDER BY pos) AS picked FROM kept GROUP BY {key}),
short AS (
  SELECT words.{key}, CASE WHEN len(ws) > {budget} THEN picked ELSE whole END AS prompt,
    CAST(len(ws) AS INTEGER) AS orig_tokens, CAST(least(len(ws), {budget}) AS INTEGER) AS compressed_tokens
  FROM words LEFT JOIN joined USING ({key})
)"""


_ALTERED = """CASE lang WHEN 'en' THEN '  ' || text || '!' WHEN 'fr' THEN text || ' 42' WHEN 'de' THEN ''
  ELSE replace(text, 'e', 'a') END"""
_PROMPTED = f"{DIALOGUE_SQL}, prompted AS (SELECT *, {PROMPT_SQL} AS prompt FROM samples)"

#: SQL has no subword tokenizer; ``tests`` compares these with the plain library call.
WITHOUT_SQL: dict[str, Query] = {
    "compress_with_tokenizer": _compress_with_tokenizer,
    "input_window_bpe": _input_window_bpe,
    "token_count_bpe": _token_count_bpe,
}

ORACLES: dict[str, str] = {
    "build_prompt": f"WITH {_PROMPTED} SELECT id, prompt FROM prompted",
    "premise_select": f"""WITH {_PROMPTED},
        chosen AS (SELECT id, CASE WHEN trim(context) <> '' THEN context ELSE prompt END AS whole FROM prompted)
        SELECT id, {truncated_sql("whole", "400")} AS premise FROM chosen""",
    "token_count": f"SELECT doc_id, CAST(len({words_sql('text')}) AS INTEGER) AS tokens FROM documents",
    "hard_truncate": f"SELECT doc_id, {truncated_sql('text', '1024')} AS prompt FROM documents",
    "input_window": f"""WITH caps AS (
          SELECT doc_id, text, CAST(CASE lang WHEN 'en' THEN 600 - 64 - 8 WHEN 'fr' THEN 2048 - 64 - 8
            WHEN 'de' THEN 1024 - 64 - 8 ELSE 4096 - 64 - 8 END AS INTEGER) AS cap FROM documents)
        SELECT doc_id, cap, {truncated_sql('text', 'cap')} AS prompt,
          CAST(least(len({words_sql('text')}), cap) AS INTEGER) AS tokens, len({words_sql('text')}) >= cap AS truncated
        FROM caps""",
    "compress_to_budget": f"WITH {compress_sql('documents', 'doc_id', 'text', BUDGET)} SELECT * FROM short",
    "compression_decision": f"""WITH {_PROMPTED}, {compress_sql('prompted', 'id', 'prompt', BUDGET)}
        SELECT id, CASE WHEN answer = '' OR orig_tokens <= {BUDGET} THEN prompted.prompt ELSE short.prompt END AS prompt,
          CASE WHEN answer = '' THEN 0 ELSE orig_tokens END AS orig_tokens,
          CASE WHEN answer = '' THEN 0 ELSE compressed_tokens END AS compressed_tokens,
          answer <> '' AND orig_tokens > {BUDGET} AS was_compressed
        FROM prompted JOIN short USING (id)""",
    "error_classify": """WITH texts AS (
          SELECT 'events' AS origin, event_id AS row_id, CASE event_type WHEN 'error' THEN 'CUDA error: ' || props
            WHEN 'purchase' THEN props || ' CUBLAS_STATUS_ALLOC_FAILED'
            WHEN 'click' THEN 'Out of Memory, ' || props ELSE props END AS message FROM events
          UNION ALL SELECT 'documents', doc_id, text FROM documents)
        SELECT origin, row_id,
          regexp_matches(lower(message), 'out of memory|cublas_status_alloc_failed|cuda error') AS out_of_memory FROM texts""",
    "sentinel_rows": f"""SELECT CAST(doc_id AS VARCHAR) AS id, source AS dataset, '{MODELS[0]}' AS model_name,
          CASE lang WHEN 'en' THEN 1 ELSE 0 END AS compressed,
          CASE lang WHEN 'en' THEN '[SKIPPED_ERROR] ValueError: ' || substr(text, 1, 180) ELSE lang END AS prediction,
          CASE lang WHEN 'en' THEN 0.0e0 ELSE 0.75e0 END AS exact_match,
          CASE lang WHEN 'en' THEN 0.0e0 ELSE 0.75e0 END AS keyword_match,
          CASE lang WHEN 'en' THEN 0.0e0 ELSE 0.75e0 END AS self_consistency,
          CASE lang WHEN 'en' THEN 0.0e0 ELSE 0.75e0 END AS nli_support,
          CASE lang WHEN 'en' THEN 1.0e0 ELSE 0.75e0 END AS hallucination
        FROM documents WHERE lang <> 'fr'""",
    "normalize_text": f"SELECT doc_id, {normalized_sql('text')} AS normalized FROM documents",
    "last_number": f"""SELECT 'documents' AS origin, doc_id AS row_id, {last_number_sql('text')} AS number FROM documents
        UNION ALL SELECT 'events', event_id, {last_number_sql('props')} FROM events""",
    "exact_match": f"""WITH pairs AS (SELECT doc_id, text, {_ALTERED} AS prediction FROM documents)
        SELECT doc_id, {exact_match_sql('prediction', 'text')} AS exact_match FROM pairs""",
    "keyword_match": f"""WITH pairs AS (SELECT doc_id, text, {_ALTERED} AS prediction FROM documents)
        SELECT doc_id, {keyword_match_sql('prediction', 'text')} AS keyword_match FROM pairs""",
    "response_embedding": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT vec_id, list_dot_product(e, list_concat(e[2:], e[1:1])) / list_dot_product(e, e) AS self_consistency FROM v""",
    "self_consistency": """WITH v AS (
          SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
            greatest(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 1e-8) AS norm
          FROM embeddings
        ), pairs AS (
          SELECT a.label, sum(list_dot_product(a.e, b.e) / (a.norm * b.norm)) AS total
          FROM v a JOIN v b ON a.label = b.label GROUP BY a.label
        ), sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
        SELECT label, CAST(n AS BIGINT) AS responses,
          CASE WHEN n = 1 THEN 1.0e0 ELSE (total - n) / (CAST(n AS DOUBLE) * (n - 1)) END AS self_consistency
        FROM pairs JOIN sizes USING (label)""",
    "softmax_support": """WITH logits AS (
          SELECT vec_id, label, list_transform([0, 1, 2], lambda c: list_sum(list_filter(CAST(embedding AS DOUBLE[]),
            lambda x, i: (i - 1) % 3 = c))) AS z FROM embeddings)
        SELECT vec_id, CASE WHEN label = 0 THEN 0.0e0 ELSE exp(z[3] - list_max(z))
          / (exp(z[1] - list_max(z)) + exp(z[2] - list_max(z)) + exp(z[3] - list_max(z))) END AS support FROM logits""",
}
