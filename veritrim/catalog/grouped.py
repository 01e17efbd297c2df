"""Deduplication, pairs, group means, deltas and findings over the results log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrim.catalog.base import Query, log_of, over_clean, over_log, table
from veritrim.functions.metrics import exact_mean, hallucination, model_family
from veritrim.operators.aggregates import (
    clean_log,
    condition_cells,
    experiment_summary,
    family_means,
    family_order,
    insights,
    mean_delta,
    mean_metrics,
    mode_series,
    pivot_modes,
    token_bins,
    token_scatter,
)
from veritrim.operators.dedup import FILE_ORDER, keep_last
from veritrim.operators.pairing import delta_stats, latest_paired_delta, paired_delta
from veritrim.plans.analysis import analyse, compression_effect, model_dataset_deltas
from veritrim.plans.results_log import results_log_text
from veritrim.schemas import METRICS
from veritrim.session import shared_folder
from veritrim.sources.readers import read_table
from veritrim.sources.writers import write_summary

TIE = ["event_id"]
BY_MODE = ["model_name", "compression_label"]
BOTH = ["nli_support", "hallucination"]


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_log(log_of(spark, sf_dir), tiebreak=TIE)


def _means(by: list[str], metrics: list[str] | tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: mean_metrics(_clean(spark, sf_dir), by, metrics)


def _condition_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["model_name", "dataset", "compressed"]
    return mean_metrics(_clean(spark, sf_dir), by, BOTH)


def _pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_modes(_condition_means(spark, sf_dir))


def _delta_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_dataset_deltas(condition_cells(_clean(spark, sf_dir)))


def _clean_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_log(results_log_text(table(spark, sf_dir, "events")), tiebreak=TIE)
    return cleaned.select("event_id", "id", "dataset", "model_name", "compressed", "compression_label", *BOTH)


def _gappy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log, with prompts of twenty to forty tokens without a time."""
    gap = F.col("orig_tokens").between(20, 40)
    return log_of(spark, sf_dir).withColumn("timestamp", F.when(~gap, F.col("timestamp")))


def _summary_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary file as a reader finds it."""
    path = shared_folder(spark, "summary-file")
    write_summary(experiment_summary(log_of(spark, sf_dir)), path, fmt="parquet", digits=None)
    return spark.read.parquet(path)


def _tables_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the analysis as a reader finds them: rows of each, and the sum of its first measure."""
    folder = shared_folder(spark, "analysis")
    analyse(log_of(spark, sf_dir), folder, fmt="parquet", tiebreak=TIE)
    measure = {
        "agg_mean_nli_per_model_compression": "mean_nli_support",
        "agg_mean_hallucination_per_model_compression": "mean_hallucination_rate",
        "agg_mean_hallucination_per_model": "mean_hallucination_rate",
        "agg_mean_metrics_per_dataset": "mean_exact_match",
        "delta_metrics_model_dataset": "delta_nli",
        "delta_metrics_by_model": "delta_nli",
        "delta_metrics_by_dataset": "delta_nli",
    }
    parts = [
        spark.read.parquet(f"{folder}/{name}").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), exact_mean(F.col(c)).alias("mean_value")
        )
        for name, c in measure.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _family_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir).withColumn("model_family", model_family(F.col("model_name")))
    counts = log.groupBy("model_family").agg(F.count(F.lit(1)).alias("n"))
    return family_order(counts).select("model_family", "order_idx", "n")


def _hallucination_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir)
    return log.select("event_id", "nli_support", hallucination(F.col("nli_support")).alias("flag"))


def _dedup_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a time: the last one as the file has them stays."""
    events = read_table(spark, f"{sf_dir.rstrip('/')}/events.parquet").select("user_id", "event_type", "props", "value", FILE_ORDER)
    return keep_last(events, ["user_id", "event_type"], time_col=None).drop(FILE_ORDER)


QUERIES: dict[str, Query] = {
    "compression_effect": lambda s, d: compression_effect(log_of(s, d), TIE),
    "dedup_keep_last": lambda s, d: keep_last(log_of(s, d), tiebreak=TIE),
    "dedup_missing_time_wins": lambda s, d: keep_last(_gappy_log(s, d), tiebreak=TIE, missing_time_wins=True),
    "dedup_without_time": lambda s, d: keep_last(log_of(s, d).drop("timestamp"), time_col=None, tiebreak=TIE),
    "dedup_file_order": _dedup_file_order,
    "summary_written": _summary_written,
    "tables_written": _tables_written,
    "clean_required": _clean_required,
    "paired_delta": lambda s, d: paired_delta(log_of(s, d)),
    "paired_delta_dedup": lambda s, d: latest_paired_delta(log_of(s, d), tiebreak=TIE),
    "paired_delta_by_id": lambda s, d: delta_stats(paired_delta(log_of(s, d), ["id"])),
    "delta_stats": lambda s, d: delta_stats(paired_delta(log_of(s, d))),
    "experiment_summary": lambda s, d: experiment_summary(log_of(s, d)),
    "mean_nli_model_mode": _means(BY_MODE, ["nli_support"]),
    "mean_hall_model_mode": _means(BY_MODE, ["hallucination"]),
    "mean_hall_model": _means(["model_name"], ["hallucination"]),
    "mean_metrics_dataset": _means(["dataset"], METRICS),
    "mean_nli_dataset_mode": _means(["dataset", "compression_label"], ["nli_support"]),
    "condition_means": lambda s, d: _condition_means(s, d),
    "delta_pivot": lambda s, d: _pivot(s, d),
    "delta_by_model": lambda s, d: mean_delta(_pivot(s, d), "model_name"),
    "delta_by_dataset": lambda s, d: mean_delta(_pivot(s, d), "dataset"),
    "delta_guarded": _delta_guarded,
    "mean_hall_family": lambda s, d: family_means(mean_metrics(_clean(s, d), ["model_name"], ["hallucination"])),
    "family_order": _family_order,
    "series_by_model": lambda s, d: mode_series(mean_metrics(_clean(s, d), BY_MODE, ["hallucination"]), "model_name", "mean_hallucination_rate"),
    "series_by_dataset": lambda s, d: mode_series(
            mean_metrics(_clean(s, d), ["dataset", "compression_label"], ["nli_support"]),
            "dataset",
            "mean_nli_support",
        ),
    "tokens_vs_hallucination": lambda s, d: token_scatter(_clean(s, d)),
    "tokens_hallucination_bins": lambda s, d: token_bins(_clean(s, d)),
    "insights": lambda s, d: insights(condition_cells(_clean(s, d))),
    "hallucination_flag": _hallucination_flag,
    "model_family": lambda s, d: log_of(s, d).select(
        "event_id", "model_name", model_family(F.col("model_name")).alias("model_family")
    ),
}

# Pairs of a log: exactly two rows per key, one of each mode.
_PAIRS = """, pairs AS (
  SELECT {key}, max(nli_support) FILTER (compressed = 1) - max(nli_support) FILTER (compressed = 0) AS delta_nli,
    max(hallucination) FILTER (compressed = 1) - max(hallucination) FILTER (compressed = 0) AS delta_hallucination
  FROM {log} GROUP BY {key}
  HAVING count(*) = 2 AND count(*) FILTER (compressed = 0) = 1 AND count(*) FILTER (compressed = 1) = 1
)"""
_PAIR_KEY = "id, dataset, model_name"
_RAW_PAIRS = _PAIRS.format(key=_PAIR_KEY, log="results_log")
_CLEAN_PAIRS = _PAIRS.format(key=_PAIR_KEY, log="clean")
_ID_PAIRS = _PAIRS.format(key="id", log="results_log")

_STATS = """CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (delta_nli > 0) AS BIGINT) AS improved,
  CAST(count(*) FILTER (delta_nli < 0) AS BIGINT) AS worsened,
  CAST(count(*) FILTER (delta_nli = 0) AS BIGINT) AS unchanged,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (delta_nli > 0) * 100.0e0 / count(*) END AS improved_pct,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (delta_nli < 0) * 100.0e0 / count(*) END AS worsened_pct,
  coalesce(avg(delta_nli), 0.0e0) AS avg_delta_nli"""

_SUMMARY = """CAST(count(*) AS BIGINT) AS count,
  avg(exact_match) AS avg_exact_match, avg(keyword_match) AS avg_keyword_match,
  avg(self_consistency) AS avg_self_consistency, avg(nli_support) AS avg_nli_support,
  avg(hallucination) AS hallucination_rate FROM results_log"""

SUMMARY_SQL = over_log(
    f"""
SELECT 'overall' AS "group", CAST(NULL AS VARCHAR) AS dataset, CAST(NULL AS INTEGER) AS compressed, {_SUMMARY}
HAVING count(*) > 0
UNION ALL SELECT 'dataset=' || dataset, dataset, NULL, {_SUMMARY} GROUP BY dataset
UNION ALL SELECT 'compressed=' || CAST(compressed AS VARCHAR), NULL, compressed, {_SUMMARY} GROUP BY compressed"""
)

_CONDITIONS = """, conditions AS (
  SELECT model_name, dataset, CAST(compressed AS DOUBLE) AS compressed,
    avg(nli_support) AS nli, avg(hallucination) AS hall, sum(hallucination) AS sum_hall, count(hallucination) AS n_hall
  FROM clean GROUP BY model_name, dataset, compressed
), wide AS (
  SELECT model_name, dataset,
    max(nli) FILTER (compressed = 0) AS nli_support_0, max(nli) FILTER (compressed = 1) AS nli_support_1,
    max(hall) FILTER (compressed = 0) AS hallucination_0, max(hall) FILTER (compressed = 1) AS hallucination_1,
    max(nli) FILTER (compressed = 1) - max(nli) FILTER (compressed = 0) AS delta_nli,
    max(hall) FILTER (compressed = 1) - max(hall) FILTER (compressed = 0) AS delta_hallucination,
    sum(sum_hall) AS sum_hall, sum(n_hall) AS n_hall
  FROM conditions GROUP BY model_name, dataset
)"""
_WIDE_COLUMNS = """model_name, dataset, nli_support_0 AS nli_support_0, nli_support_1 AS nli_support_1,
  hallucination_0 AS hallucination_0, hallucination_1 AS hallucination_1,
  delta_nli AS delta_nli, delta_hallucination AS delta_hallucination"""


def _mean_sql(by: str, metric: str) -> str:
    name = "mean_nli_support" if metric == "nli_support" else "mean_hallucination_rate"
    return over_clean("", f"SELECT {by}, avg({metric}) AS {name} FROM clean GROUP BY {by}")


def _delta_sql(by: str) -> str:
    return over_clean(
        _CONDITIONS,
        f"""SELECT {by}, avg(delta_nli) AS delta_nli, avg(delta_hallucination) AS delta_hallucination
        FROM wide GROUP BY {by}""",
    )


def _series_sql(category: str, metric: str) -> str:
    return over_clean(
        "",
        f"""SELECT {category}, avg({metric}) FILTER (compressed <> 1) AS uncompressed,
        avg({metric}) FILTER (compressed = 1) AS compressed FROM clean GROUP BY {category}""",
    )


_FAMILY = """CASE WHEN contains(lower(model_name), 'tiny') THEN 'Tiny' WHEN contains(lower(model_name), 'phi') THEN 'Phi'
  WHEN contains(lower(model_name), 'llama-2') THEN 'LLaMA2' WHEN contains(lower(model_name), 'mistral') THEN 'Mistral'
  WHEN contains(lower(model_name), 'llama-3') THEN 'LLaMA3' ELSE model_name END"""
_FAMILY_INDEX = "CAST(list_position(['Tiny', 'Phi', 'LLaMA2', 'Mistral', 'LLaMA3'], model_family) - 1 AS INTEGER)"


def _finding(kind: str, entity: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT '{kind}' AS kind, {entity} AS entity, delta_nli, delta_hall, rate FROM by_{entity}
    ORDER BY {order} NULLS LAST, {entity} LIMIT 1)"""


def _entity(name: str) -> str:
    return f""", by_{name} AS (SELECT {name}, avg(delta_nli) AS delta_nli,
    avg(delta_hallucination) AS delta_hall, sum(sum_hall) / sum(n_hall) AS rate FROM wide GROUP BY {name})"""


_INSIGHTS = over_clean(
    _CONDITIONS + _entity("model_name") + _entity("dataset"),
    " UNION ALL ".join(
        [
            _finding("best_model_by_delta", "model_name", "delta_nli DESC"),
            _finding("best_dataset_by_delta", "dataset", "delta_nli DESC"),
            _finding("worst_model_by_delta", "model_name", "delta_nli"),
            _finding("lowest_hallucination_model", "model_name", "rate"),
            _finding("lowest_hallucination_dataset", "dataset", "rate"),
        ]
    ),
)

def _written(name: str, measure: str, source: str) -> str:
    return f"""SELECT '{name}' AS table_name, CAST(count(*) AS BIGINT) AS n, avg(v) AS mean_value FROM (SELECT {measure} AS v FROM {source})"""


ORACLES: dict[str, str] = {
    "compression_effect": over_clean(
        _CLEAN_PAIRS, f"SELECT model_name, dataset, {_STATS} FROM pairs GROUP BY model_name, dataset"
    ),
    "dedup_keep_last": over_clean("", "SELECT * EXCLUDE (compression_label) FROM clean"),
    "dedup_missing_time_wins": over_log(
        """, gappy AS (SELECT * REPLACE (CASE WHEN orig_tokens BETWEEN 20 AND 40 THEN NULL ELSE "timestamp" END AS "timestamp")
          FROM results_log)
        SELECT * FROM gappy QUALIFY row_number() OVER (
          PARTITION BY id, dataset, model_name, compressed ORDER BY "timestamp" DESC NULLS FIRST, event_id DESC) = 1"""
    ),
    "dedup_without_time": over_log(
        """SELECT * EXCLUDE ("timestamp") FROM results_log QUALIFY row_number() OVER (
          PARTITION BY id, dataset, model_name, compressed ORDER BY event_id DESC) = 1"""
    ),
    # Rows of a file come in order; the last of a key has often not the highest values.
    "dedup_file_order": """SELECT user_id, event_type, props, value FROM (
          SELECT *, row_number() OVER () AS place FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY place DESC) = 1""",
    "summary_written": f'SELECT * EXCLUDE (dataset, compressed) FROM ({SUMMARY_SQL})',
    "tables_written": over_clean(
        _CONDITIONS,
        f"""{_written("agg_mean_nli_per_model_compression", "avg(nli_support)", "clean GROUP BY model_name, compression_label")}
        UNION ALL {_written("agg_mean_hallucination_per_model_compression", "avg(hallucination)", "clean GROUP BY model_name, compression_label")}
        UNION ALL {_written("agg_mean_hallucination_per_model", "avg(hallucination)", "clean GROUP BY model_name")}
        UNION ALL {_written("agg_mean_metrics_per_dataset", "avg(exact_match)", "clean GROUP BY dataset")}
        UNION ALL {_written("delta_metrics_model_dataset", "delta_nli", "wide")}
        UNION ALL {_written("delta_metrics_by_model", "avg(delta_nli)", "wide GROUP BY model_name")}
        UNION ALL {_written("delta_metrics_by_dataset", "avg(delta_nli)", "wide GROUP BY dataset")}""",
    ),
    "clean_required": over_log(
        """, text_log AS (
  SELECT * REPLACE (
    CASE WHEN orig_tokens < 5 THEN NULL ELSE nli_support END AS nli_support,
    CASE WHEN orig_tokens BETWEEN 5 AND 7 THEN NULL ELSE hallucination END AS hallucination,
    CASE WHEN orig_tokens BETWEEN 20 AND 40 THEN NULL ELSE "timestamp" END AS "timestamp")
  FROM results_log
), latest AS (
  SELECT * FROM text_log QUALIFY row_number() OVER (
    PARTITION BY id, dataset, model_name, compressed ORDER BY "timestamp" DESC NULLS LAST, CAST(event_id AS BIGINT) DESC) = 1
)
SELECT event_id, id, dataset, model_name, CAST(compressed AS DOUBLE) AS compressed,
  CASE WHEN compressed = 1 THEN 'compressed' ELSE 'uncompressed' END AS compression_label,
  nli_support AS nli_support, hallucination AS hallucination
FROM latest WHERE nli_support IS NOT NULL AND hallucination IS NOT NULL"""
    ),
    "paired_delta": over_log(
        f"{_RAW_PAIRS} SELECT {_PAIR_KEY}, delta_nli AS delta_nli, "
        "delta_hallucination AS delta_hallucination FROM pairs"
    ),
    "paired_delta_dedup": over_clean(
        _CLEAN_PAIRS,
        f"SELECT {_PAIR_KEY}, delta_nli AS delta_nli, "
        "delta_hallucination AS delta_hallucination FROM pairs",
    ),
    "paired_delta_by_id": over_log(f"{_ID_PAIRS} SELECT {_STATS} FROM pairs"),
    "delta_stats": over_log(f"{_RAW_PAIRS} SELECT {_STATS} FROM pairs"),
    "experiment_summary": SUMMARY_SQL,
    "mean_nli_model_mode": _mean_sql("model_name, compression_label", "nli_support"),
    "mean_hall_model_mode": _mean_sql("model_name, compression_label", "hallucination"),
    "mean_hall_model": _mean_sql("model_name", "hallucination"),
    "mean_nli_dataset_mode": _mean_sql("dataset, compression_label", "nli_support"),
    "mean_metrics_dataset": over_clean(
        "",
        """SELECT dataset, avg(exact_match) AS mean_exact_match, avg(keyword_match) AS mean_keyword_match,
        avg(self_consistency) AS mean_self_consistency, avg(nli_support) AS mean_nli_support,
        avg(hallucination) AS mean_hallucination_rate FROM clean GROUP BY dataset""",
    ),
    "condition_means": over_clean(
        _CONDITIONS,
        """SELECT model_name, dataset, compressed, nli AS mean_nli_support,
        hall AS mean_hallucination_rate FROM conditions""",
    ),
    "delta_pivot": over_clean(_CONDITIONS, f"SELECT {_WIDE_COLUMNS} FROM wide"),
    "delta_by_model": _delta_sql("model_name"),
    "delta_by_dataset": _delta_sql("dataset"),
    "delta_guarded": over_clean(
        _CONDITIONS,
        f"""SELECT {_WIDE_COLUMNS} FROM wide
        WHERE (SELECT bool_or(compressed = 0) AND bool_or(compressed = 1) FROM conditions)""",
    ),
    "mean_hall_family": over_clean(
        f""", models AS (SELECT {_FAMILY} AS model_family, avg(hallucination) AS rate FROM clean GROUP BY model_name)""",
        f"""SELECT model_family, avg(rate) AS mean_hallucination_rate, {_FAMILY_INDEX} AS order_idx
        FROM models GROUP BY model_family HAVING {_FAMILY_INDEX} IS NOT NULL""",
    ),
    "family_order": over_log(
        f""", named AS (SELECT {_FAMILY} AS model_family FROM results_log)
        SELECT model_family, {_FAMILY_INDEX} AS order_idx, CAST(count(*) AS BIGINT) AS n FROM named
        GROUP BY model_family HAVING {_FAMILY_INDEX} IS NOT NULL"""
    ),
    "series_by_model": _series_sql("model_name", "hallucination"),
    "series_by_dataset": _series_sql("dataset", "nli_support"),
    "tokens_vs_hallucination": over_clean(
        "", "SELECT compression_label, CAST(orig_tokens AS DOUBLE) AS orig_tokens, hallucination FROM clean"
    ),
    "tokens_hallucination_bins": over_clean(
        "",
        """SELECT compression_label, CAST(floor(orig_tokens / 50.0e0) * 50 AS BIGINT) AS tokens_from,
        CAST(count(*) AS BIGINT) AS points, avg(hallucination) AS mean_hallucination_rate
        FROM clean GROUP BY ALL""",
    ),
    "insights": _INSIGHTS,
    "hallucination_flag": over_log("SELECT event_id, nli_support, hallucination AS flag FROM results_log"),
    "model_family": over_log(f"SELECT event_id, model_name, {_FAMILY} AS model_family FROM results_log"),
}
