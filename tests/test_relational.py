from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import log_rows, rows
from veritrim.operators.aggregates import (
    clean_log,
    condition_cells,
    experiment_summary,
    family_means,
    insights,
    mean_delta,
    mean_from_cells,
    mean_metrics,
    mode_series,
    pivot_modes,
    token_bins,
    token_scatter,
)
from veritrim.operators.dedup import keep_last
from veritrim.operators.grid import condition_grid, pending_cells, skipped_cells
from veritrim.operators.pairing import delta_stats, latest_paired_delta, paired_delta
from veritrim.operators.vectors import self_consistency
from veritrim.plans.analysis import analysis_tables, model_dataset_deltas
from veritrim.plans.results_log import results_log
from veritrim.schemas import METRICS, Settings

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def log(spark):
    return results_log(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))


def test_keep_last(spark):
    df = log_rows(
        spark,
        [
            {"id": "1", "timestamp": T2}, {"id": "1", "timestamp": T1}, {"id": "1", "timestamp": None},
            {"id": "2", "timestamp": T1}, {"id": "2", "timestamp": T1},
            {"id": "3", "timestamp": None}, {"id": "3", "timestamp": None, "compressed": 1},
        ],
    )
    kept = lambda **kw: sorted(r.n for r in keep_last(df, tiebreak=["n"], **kw).collect())
    assert kept() == [0, 4, 5, 6]
    assert kept(missing_time_wins=True) == [2, 4, 5, 6]
    assert kept(time_col=None) == [2, 4, 5, 6]
    # Without a tie-break or a time column: by the other columns, the same row however the table lies.
    for parts in (1, 5):
        assert [keep_last(df.repartition(parts), **kw).count() for kw in ({}, {"time_col": None})] == [4, 4]
    ties = spark.createDataFrame([("1", "b", 1), ("1", "a", 2), ("1", "b", 0)], "id string, run_id string, v int")
    assert {tuple(keep_last(ties.repartition(p), ["id"], None).first()) for p in (1, 2, 3)} == {("1", "b", 1)}


def test_clean_log_deduplicates_before_it_drops(spark):
    df = log_rows(spark, [{"timestamp": T1}, {"id": "2", "timestamp": T1}]).withColumn(
        "nli_support", F.col("nli_support").cast("string")
    )
    later = log_rows(spark, [{"timestamp": T2}]).withColumns({"nli_support": F.lit("bad"), "n": F.lit(9)})
    cleaned = clean_log(df.unionByName(later), tiebreak=["n"])
    assert [(r.id, r.compression_label) for r in cleaned.collect()] == [("2", "uncompressed")]


def test_clean_log_can_leave_out_errors(spark):
    df = log_rows(spark, [{"timestamp": T1}, {"id": "2", "timestamp": T1, "prediction": "[SKIPPED_ERROR] ValueError: x"}])
    assert clean_log(df, ["n"]).count() == 2
    assert clean_log(df, ["n"], exclude_errors=True).count() == 1


def test_pairs_need_exactly_two_rows_of_both_modes(spark):
    items = [
        {"id": "pair", "nli_support": 0.25}, {"id": "pair", "compressed": 1, "nli_support": 0.75, "hallucination": 1.0},
        {"id": "one side"},
        {"id": "same mode"}, {"id": "same mode"},
        {"id": "three"}, {"id": "three", "compressed": 1}, {"id": "three", "compressed": 1},
        {"id": "odd mode"}, {"id": "odd mode", "compressed": 2},
    ]
    got = paired_delta(log_rows(spark, items)).collect()
    assert [(r.id, r.delta_nli, r.delta_hallucination) for r in got] == [("pair", 0.5, 1.0)]


def test_pairs_by_id_only(spark):
    items = [{"model_name": m, "compressed": c} for m in ("a", "b") for c in (0, 1)]
    stats = delta_stats(paired_delta(log_rows(spark, items), ["id"])).first()
    assert (stats.total, stats.improved_pct, stats.avg_delta_nli) == (0, None, 0.0)


def test_latest_pairs_equal_dedup_then_pairs(log):
    assert rows(latest_paired_delta(log, tiebreak=["event_id"])) == rows(paired_delta(keep_last(log, tiebreak=["event_id"])))


def test_delta_stats_add_up(log):
    stats = delta_stats(latest_paired_delta(log, tiebreak=["event_id"])).first()
    assert stats.total > 0 and stats.improved + stats.worsened + stats.unchanged == stats.total


def test_summary_counts_and_empty_log(spark, log):
    summary = {r.group: r["count"] for r in experiment_summary(log).collect()}
    assert summary["overall"] == log.count()
    assert sum(n for g, n in summary.items() if g.startswith("dataset=")) == summary["overall"]
    assert sum(n for g, n in summary.items() if g.startswith("compressed=")) == summary["overall"]
    assert experiment_summary(log.limit(0)).count() == 0


def test_cells_give_the_same_means_as_rows(log):
    cleaned = clean_log(log, tiebreak=["event_id"])
    cells = condition_cells(cleaned)
    six = lambda df: rows(df.select(*[F.round(c, 9) if c.startswith("mean") else c for c in df.columns]))
    for by, metrics in ((["dataset"], METRICS), (["model_name", "compression_label"], ["nli_support"])):
        assert six(mean_from_cells(cells, by, metrics)) == six(mean_metrics(cleaned, by, metrics))


def test_pivot_with_a_missing_mode(spark):
    df = log_rows(spark, [{"model_name": "a"}, {"model_name": "a", "compressed": 1, "nli_support": 0.75}, {"model_name": "b"}])
    cells = condition_cells(clean_log(df, ["n"]))
    wide = {r.model_name: r for r in model_dataset_deltas(cells).collect()}
    assert wide["a"].delta_nli == 0.25
    assert (wide["b"].nli_support_0, wide["b"].nli_support_1, wide["b"].delta_nli) == (0.5, None, None)
    ranked = mean_delta(model_dataset_deltas(cells), "model_name").collect()
    assert [r.model_name for r in ranked] == ["a", "b"]


def test_deltas_and_their_findings_are_absent_with_one_mode(spark):
    df = log_rows(spark, [{"model_name": "a"}, {"model_name": "b", "hallucination": 1.0}])
    tables = analysis_tables(condition_cells(clean_log(df, ["n"])))
    for name in ("delta_metrics_model_dataset", "delta_metrics_by_model", "delta_metrics_by_dataset"):
        assert tables[name].count() == 0
    assert {(r.kind, r.entity) for r in tables["insights"].collect()} == {
        ("lowest_hallucination_model", "a"), ("lowest_hallucination_dataset", "d"),
    }


def test_findings(spark):
    def pair(model, before, after, hall):
        return [
            {"model_name": model, "nli_support": before, "hallucination": hall},
            {"model_name": model, "nli_support": after, "hallucination": hall, "compressed": 1},
        ]

    df = log_rows(spark, pair("up", 0.25, 0.75, 1.0) + pair("down", 0.75, 0.25, 0.0) + pair("also down", 0.75, 0.25, 0.5))
    found = {r.kind: r for r in insights(condition_cells(clean_log(df, ["n"]))).collect()}
    assert found["best_model_by_delta"].entity == "up" and found["best_model_by_delta"].delta_nli == 0.5
    assert found["worst_model_by_delta"].entity == "also down"
    assert found["lowest_hallucination_model"].entity == "down"
    assert found["best_dataset_by_delta"].entity == "d"
    assert insights(condition_cells(clean_log(df.limit(0), ["n"]))).count() == 0


def test_families_drop_unknown_names_and_average_models(spark):
    df = log_rows(
        spark,
        [
            {"model_name": "phi-a", "hallucination": 1.0}, {"model_name": "phi-a", "hallucination": 1.0},
            {"model_name": "phi-b"}, {"model_name": "unknown"}, {"model_name": "tiny"},
        ],
    )
    got = family_means(mean_metrics(df, ["model_name"], ["hallucination"])).collect()
    assert [(r.model_family, r.mean_hallucination_rate, r.order_idx) for r in got] == [("Tiny", 0.0, 0), ("Phi", 0.5, 1)]


def test_series_fill_missing_sides_with_null(spark):
    df = clean_log(log_rows(spark, [{"model_name": "a"}, {"model_name": "b", "compressed": 1}]), ["n"])
    series = mode_series(mean_metrics(df, ["model_name", "compression_label"], ["nli_support"]), "model_name", "mean_nli_support")
    assert [tuple(r) for r in series.collect()] == [("a", 0.5, None), ("b", None, 0.5)]


def test_scatter_and_bins_cover_the_same_rows(log):
    cleaned = clean_log(log, tiebreak=["event_id"])
    assert token_bins(cleaned).agg(F.sum("points")).first()[0] == token_scatter(cleaned).count() == cleaned.count()


def test_grid_is_pending_plus_skipped(log):
    grid = condition_grid(log.select("id", "dataset").distinct())
    pending, skipped = pending_cells(grid, log).count(), skipped_cells(grid, log).count()
    assert pending > 0 and skipped > 0 and pending + skipped == grid.count()
    assert condition_grid(log.select("id"), Settings(compression_enabled=False)).select("requested_mode").distinct().count() == 1


def test_self_consistency_equals_all_pairs(spark):
    import numpy as np

    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(60)
    data = vectors.collect()
    for r in self_consistency(vectors, ["label"], "embedding").collect():
        v = np.array([d.embedding for d in data if d.label == r.label], dtype=float)
        u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
        n = len(u)
        expected = 1.0 if n == 1 else ((u @ u.T).sum() - n) / (n * (n - 1))
        assert r.responses == n and r.self_consistency == pytest.approx(expected, abs=1e-9)


def test_pivot_modes_ignores_other_modes(spark):
    df = clean_log(log_rows(spark, [{}, {"compressed": 1}, {"compressed": 2, "nli_support": 0.0}]), ["n"])
    means = mean_metrics(df, ["model_name", "dataset", "compressed"], ["nli_support", "hallucination"])
    assert pivot_modes(means).first().delta_nli == 0.0
