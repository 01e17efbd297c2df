"""Checks on physical plans: shuffles, joins, and where work happens."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.helpers import plan_of
from veritrim.catalog import QUERIES
from veritrim.functions.metrics import exact_match, keyword_match
from veritrim.functions.text import last_number, normalize_text
from veritrim.catalog.scoring import STREAMED, STUBS
from veritrim.operators.aggregates import experiment_summary, summary_from_sums, summary_sums
from veritrim.operators.compress import compress_to_budget, token_frequencies
from veritrim.operators.dedup import keep_last
from veritrim.operators.grid import condition_grid, pending_cells
from veritrim.operators.pairing import latest_paired_delta, paired_delta
from veritrim.operators.prepare import dialogue_samples
from veritrim.operators.vectors import self_consistency
from veritrim.plans.experiment import generate, plan_cells, score_cells
from veritrim.plans.results_log import results_log
from veritrim.schemas import RESULT_LOG
from veritrim.sources.readers import no_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def log(spark):
    return results_log(spark.read.parquet(f"{SF}/events.parquet"))


def exchanges(df):
    return len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan_of(df)))


def test_pairs_take_one_shuffle_and_no_join(log):
    for df in (paired_delta(log), latest_paired_delta(log, tiebreak=["event_id"])):
        assert exchanges(df) == 1 and "Join" not in plan_of(df)


def test_summary_expands_sums_not_rows(log):
    plan = plan_of(experiment_summary(log))
    assert plan.count("Scan parquet") == 1
    # Read upwards from the scan, rows are aggregated and shuffled before anything is expanded.
    assert plan.index("Expand") < plan.index("Exchange hashpartitioning(dataset", plan.index("Expand"))


def test_dedup_cuts_before_the_shuffle(log):
    plan = plan_of(keep_last(log, tiebreak=["event_id"]))
    assert "WindowGroupLimit" in plan.split("Exchange", 1)[1] and "Partial" in plan.split("Exchange", 1)[1]


def test_dedup_does_not_shuffle_unused_text(log):
    plan = plan_of(keep_last(log, tiebreak=["event_id"]).groupBy("dataset").agg(F.avg("nli_support")))
    assert "prediction" not in plan


def test_resumption_is_an_anti_join_and_the_grid_no_join(log):
    grid = condition_grid(log.select("id", "dataset").distinct())
    assert "Join" not in plan_of(grid)
    assert "LeftAnti" in plan_of(pending_cells(grid, log))


def test_text_metrics_stay_in_the_jvm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = F.col("text")
    df = docs.select(
        normalize_text(text), last_number(text), exact_match(text, text), keyword_match(text, text)
    )
    assert "Python" not in plan_of(df) and "Arrow" not in plan_of(df)


def test_self_consistency_forms_no_pairs(spark):
    plan = plan_of(self_consistency(spark.read.parquet(f"{SF}/embeddings.parquet"), ["label"], "embedding"))
    assert "Join" not in plan and "Python" not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_makes_a_cartesian_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_plans_inside_the_streams(spark, log):
    """What each micro-batch runs: the result of a streaming query is only a scan of what it wrote."""
    samples = dialogue_samples(spark.read.parquet(f"{SF}/conversations.parquet"))
    frequencies = token_frequencies(samples, "question")
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), STREAMED, frequencies)
    scored = score_cells(generate(cells, STUBS.generate, STREAMED), STUBS, STREAMED)
    for df in (cells, scored, summary_from_sums(summary_sums(log))):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Samples meet the keys that are still to do before their texts are grouped.
    plan = plan_of(plan_cells(samples, log, replace(STREAMED, compression_enabled=False)))
    assert "LeftSemi" in plan and "LeftAnti" in plan
    # One frequency a token: no window and no second plan, whatever the budget.
    assert "Window" not in plan_of(compress_to_budget(samples, ["id"], "question", 2000, frequencies))


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["sample_defaults"](spark, SF))
    assert "PushedFilters: [" in plan
    plan = plan_of(QUERIES["head_n_per_source"](spark, SF))
    assert "text" not in plan
