"""Sources and dataset preparation over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrim.catalog.base import Query, log_of, over_log, table
from veritrim.functions.casts import lenient_float, lenient_int, numeric, timestamp
from veritrim.functions.text import final_answer, first_or_empty, flatten_context
from veritrim.operators.numbering import number_all, number_capped
from veritrim.operators.prepare import dialogue_samples, sample_defaults, with_first_answer
from veritrim.operators.skew import first_n_per_group
from veritrim.schemas import RESULT
from veritrim.session import shared_folder
from veritrim.sources.readers import good_rows, parsed_json, read_jsonl, rejected_lines, typed_results
from veritrim.sources.writers import write_samples

HAS_DIGIT = "[0-9]"


def text_lines() -> Column:
    return F.split(F.col("text"), "\n")


def _parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two kinds: JSON event properties, and benchmark prose that is no JSON."""
    lines = (
        table(spark, sf_dir, "events")
        .select(F.lit("events").alias("source_file"), F.col("event_id").alias("line_id"), F.col("props").alias("line"))
        .unionByName(
            table(spark, sf_dir, "benchmark").select(
                F.lit("benchmark").alias("source_file"), F.col("item_id").alias("line_id"), F.col("text").alias("line")
            )
        )
    )
    parsed = parsed_json(F.col("line"), T.StructType([T.StructField("k", T.LongType())]))
    return lines.withColumn("_p", parsed).select("source_file", "line_id", "_p.*")


def _jsonl_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = rejected_lines(_parsed_lines(spark, sf_dir))
    return rejects.groupBy("source_file").agg(F.count(F.lit(1)).alias("rejected"))


def _multi_source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("source").alias("dataset"), F.col("text").alias("question")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), F.lit("dialogue").alias("dataset"),
        F.col("role").alias("context"), F.col("text").alias("question"),
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("id"), F.col("text").alias("question")
    )
    return documents.unionByName(turns, allowMissingColumns=True).unionByName(items, allowMissingColumns=True)


def _results_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = log_of(spark, sf_dir).select(*[F.col(c).cast("string").alias(c) for c in RESULT.names])
    return typed_results(text).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def _final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.col("text"), F.lit(" #### "), F.col("n_chars").cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", final_answer(marked).alias("answer"), final_answer(F.col("text")).alias("unmarked")
    )


def _first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a document as its answer array; the ten first answerable documents per language."""
    found = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("dataset"),
        "doc_id",
        F.regexp_extract_all("text", F.lit("([0-9]+)"), F.lit(1)).alias("answers"),
    )
    capped = first_n_per_group(with_first_answer(found, "answers"), ["dataset"], [F.col("doc_id")], 10)
    prefix = F.concat(F.col("dataset"), F.lit("_"))
    return number_capped(capped, "dataset", [F.col("doc_id")], prefix).select("id", "dataset", "doc_id", "answer")


def _context_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as paragraphs, titled by the first words of the lines that have any: lengths may differ."""
    filled = F.filter(text_lines(), lambda line: line != "")
    titles = F.transform(filled, lambda line: F.substring_index(line, " ", 1))
    sentences = F.transform(text_lines(), lambda line: F.split(line, r"\. "))
    return table(spark, sf_dir, "documents").select("doc_id", flatten_context(titles, sentences).alias("context"))


def _first_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = F.filter(text_lines(), lambda line: line.rlike(HAS_DIGIT))
    return table(spark, sf_dir, "documents").select("doc_id", first_or_empty(numbered).alias("context"))


def _head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return first_n_per_group(documents, ["source"], [F.col("doc_id")], 25).select("source", "doc_id", "n_chars")


def _sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("source", "doc_id")
    return number_all(documents, "source", "doc_id", F.concat(F.col("source"), F.lit("_")))


def _samples_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample file as a reader of JSON lines finds it."""
    path = shared_folder(spark, "samples")
    write_samples(dialogue_samples(table(spark, sf_dir, "conversations")), path)
    return good_rows(read_jsonl(spark, path)).drop("source_file")


def partial_samples(turns: DataFrame) -> DataFrame:
    """Turns as samples with gaps: which fields are there depends on the role."""
    role, text = F.col("role"), F.col("text")
    return turns.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.when(role == "user", "dialogue").alias("dataset"),
        F.when(role == "assistant", text).alias("context"),
        F.when(role != "system", text).alias("question"),
        F.when(role == "user", text).alias("answer"),
    )


def number_texts() -> Column:
    """Good and bad number texts, by event type."""
    kind, value = F.col("event_type"), F.col("value").cast("string")
    return (
        F.when(kind == "view", value)
        .when(kind == "click", F.concat(F.lit("  -"), value, F.lit("\n")))
        .when(kind == "signup", F.lit(""))
        .when(kind == "purchase", F.col("props"))
        .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("e2")))
    )


def time_texts() -> Column:
    """Times with and without microseconds, with a T, and bad ones, by event type."""
    kind, time = F.col("event_type"), F.col("ts").cast("string")
    return (
        F.when(kind == "view", time)
        .when(kind == "click", F.replace(time, F.lit(" "), F.lit("T")))
        .when(kind == "signup", F.substring(time, 1, 19))
        .when(kind == "purchase", F.col("props"))
        .otherwise(F.substring(time, 1, 10))
    )


def _lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = number_texts()
    return table(spark, sf_dir, "events").select(
        "event_id", lenient_int(text).alias("as_int"), lenient_float(text).alias("as_float")
    )


def _numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", numeric(number_texts()).alias("number"))


def _timestamp_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", timestamp(time_texts()).cast("timestamp_ntz").alias("parsed")
    )


QUERIES: dict[str, Query] = {
    "jsonl_load": lambda s, d: good_rows(_parsed_lines(s, d)),
    "jsonl_rejects": _jsonl_rejects,
    "multi_source_union": _multi_source_union,
    "results_load": lambda s, d: _results_load(s, d),
    "final_answer_extract": _final_answers,
    "first_answer_filter": _first_answers,
    "context_flatten": _context_flatten,
    "first_or_empty": _first_or_empty,
    "head_n_per_source": _head_n,
    "sequential_ids": _sequential_ids,
    "samples_written": _samples_written,
    "unified_samples": lambda s, d: dialogue_samples(table(s, d, "conversations")),
    "sample_defaults": lambda s, d: sample_defaults(partial_samples(table(s, d, "conversations"))),
    "lenient_cast": lambda s, d: _lenient_cast(s, d),
    "numeric_coerce": lambda s, d: _numeric_coerce(s, d),
    "timestamp_coerce": _timestamp_coerce,
}

DIALOGUE_SQL = """
samples AS (
  SELECT 'conv_' || CAST(u.conv_id AS VARCHAR) || '_' || CAST(u.turn AS VARCHAR) AS id, 'dialogue' AS dataset,
    coalesce(s.text, '') AS context, u.text AS question, coalesce(a.text, '') AS answer
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s
    ON s.conv_id = u.conv_id
  WHERE u.role = 'user'
)"""

_NUMBER_TEXT = """CASE event_type WHEN 'view' THEN CAST(value AS VARCHAR) WHEN 'click' THEN '-' || CAST(value AS VARCHAR)
  WHEN 'signup' THEN NULL WHEN 'purchase' THEN NULL ELSE CAST(user_id AS VARCHAR) || 'e2' END"""

ORACLES: dict[str, str] = {
    "jsonl_load": """SELECT 'events' AS source_file, event_id AS line_id,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "jsonl_rejects": """SELECT 'benchmark' AS source_file, CAST(count(*) AS BIGINT) AS rejected
        FROM benchmark HAVING count(*) > 0""",
    "multi_source_union": """
        SELECT CAST(doc_id AS VARCHAR) AS id, source AS dataset, CAST(NULL AS VARCHAR) AS context, text AS question FROM documents
        UNION ALL SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), 'dialogue', role, text FROM conversations
        UNION ALL SELECT CAST(item_id AS VARCHAR), NULL, NULL, text FROM benchmark""",
    "results_load": over_log(
        """SELECT id, dataset, model_name, CAST(compressed AS BIGINT) AS compressed,
        CAST(orig_tokens AS BIGINT) AS orig_tokens, CAST(compressed_tokens AS BIGINT) AS compressed_tokens, prediction,
        exact_match, keyword_match, self_consistency AS self_consistency, nli_support AS nli_support,
        hallucination, run_id, "timestamp" FROM results_log"""
    ),
    "final_answer_extract": r"""SELECT doc_id, CAST(n_chars AS VARCHAR) AS answer,
        regexp_replace(string_split(text, '####')[-1], '^\s+|\s+$', '', 'g') AS unmarked FROM documents""",
    "first_answer_filter": """WITH found AS (
          SELECT lang AS dataset, doc_id, regexp_extract_all(text, '[0-9]+') AS answers FROM documents
        ), numbered AS (
          SELECT dataset, doc_id, answers[1] AS answer, row_number() OVER (PARTITION BY dataset ORDER BY doc_id) AS n
          FROM found WHERE len(answers) > 0
        ) SELECT dataset || '_' || CAST(n AS VARCHAR) AS id, dataset, doc_id, answer FROM numbered WHERE n <= 10""",
    "context_flatten": r"""WITH parts AS (
          SELECT doc_id, string_split(text, chr(10)) AS lines,
            list_filter(string_split(text, chr(10)), lambda line: line <> '') AS filled FROM documents
        ) SELECT doc_id, array_to_string(list_transform(range(1, least(len(lines), len(filled)) + 1),
          lambda i: string_split(filled[i], ' ')[1] || ': '
            || array_to_string(string_split(lines[i], '. '), ' ') || chr(10) || chr(10)), '') AS context
        FROM parts""",
    "first_or_empty": """SELECT doc_id, coalesce(list_filter(string_split(text, chr(10)),
        lambda line: regexp_matches(line, '[0-9]'))[1], '') AS context FROM documents""",
    "head_n_per_source": """SELECT source, doc_id, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25""",
    "sequential_ids": """SELECT source, doc_id,
        source || '_' || CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR) AS id FROM documents""",
    "samples_written": f"WITH {DIALOGUE_SQL} SELECT * FROM samples",
    "unified_samples": f"WITH {DIALOGUE_SQL} SELECT * FROM samples",
    "sample_defaults": """SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id,
        CASE role WHEN 'user' THEN 'dialogue' ELSE 'unknown' END AS dataset,
        CASE role WHEN 'assistant' THEN text ELSE '' END AS context, text AS question,
        CASE role WHEN 'user' THEN text ELSE '' END AS answer FROM conversations WHERE role <> 'system'""",
    "lenient_cast": f"""SELECT event_id, CAST(coalesce(trunc(TRY_CAST({_NUMBER_TEXT} AS DOUBLE)), 0) AS BIGINT) AS as_int,
        coalesce(TRY_CAST({_NUMBER_TEXT} AS DOUBLE), 0.0e0) AS as_float FROM events""",
    "numeric_coerce": f"SELECT event_id, TRY_CAST({_NUMBER_TEXT} AS DOUBLE) AS number FROM events",
    "timestamp_coerce": """SELECT event_id, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts
        WHEN 'signup' THEN date_trunc('second', ts) WHEN 'purchase' THEN NULL ELSE date_trunc('day', ts) END AS parsed
        FROM events""",
}
