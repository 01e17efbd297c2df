"""Manifests, the index of a log, and what writers that die or collide leave behind."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import log_rows, rows
from veritrim.operators import key_index
from veritrim.operators.grid import condition_grid, pending_cells
from veritrim.operators.results import result_rows
from veritrim.plans.experiment import Scorers, run_batch
from veritrim.schemas import SAMPLE, Settings
from veritrim.sources import commits
from veritrim.sources.readers import logged_cells_of, read_log
from veritrim.sources.writers import append_results, publish_tables, read_tables

NOW = datetime(2024, 1, 1)


def batch(spark, first, n, batch_id=0, dataset="d"):
    items = [{"id": str(i), "dataset": dataset, "model_name": "m"} for i in range(first, first + n)]
    df = log_rows(spark, items).withColumns({"compressed_tokens": F.lit(1), "requested_mode": F.lit(0)})
    return result_rows(df, "run", F.lit(NOW), batch_id)


def ids(spark, log):
    return sorted(int(r.id) for r in read_log(spark, log).select("id").collect())


def test_a_batch_killed_before_its_manifest_is_never_read(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    append_results(batch(spark, 0, 3), log)

    def die(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(commits, "publish", die)
        append_results(batch(spark, 3, 3, 1), log)
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(key_index, "extended", die)
        append_results(batch(spark, 3, 3, 1, "e"), log)
    assert len(list((tmp_path / "log").glob("dataset=*/commit=*"))) == 3
    assert ids(spark, log) == [0, 1, 2]
    # Killed between two files of its folder: one is missing, nobody sees the other.
    next((tmp_path / "log" / "dataset=e").glob("commit=*/part*")).unlink()
    append_results(batch(spark, 3, 3, 1), log)
    assert ids(spark, log) == [0, 1, 2, 3, 4, 5]
    assert commits.sweep(spark, log) == []  # too young
    gone = commits.sweep(spark, log, 0.0)
    assert len([g for g in gone if g.startswith("c")]) == len(gone) >= 2
    assert ids(spark, log) == [0, 1, 2, 3, 4, 5]
    assert commits.sweep(spark, log, 0.0) == []


def test_of_two_writers_one_is_told(spark, tmp_path):
    log = str(tmp_path / "log")
    append_results(batch(spark, 0, 2), log)
    seen = commits.state(spark, log)
    append_results(batch(spark, 2, 2), log, "a", 0, seen)
    with pytest.raises(commits.ConcurrentCommit):
        append_results(batch(spark, 2, 2), log, "b", 0, seen)
    assert ids(spark, log) == [0, 1, 2, 3]
    assert len(list((tmp_path / "log").glob("dataset=*/commit=*"))) == 2
    append_results(batch(spark, 4, 1), log, "b", 1)
    held = commits.state(spark, log)
    assert held["version"] == 3 and [e["run_id"] for e in held["entries"]] == [None, "a", "b"]
    assert ids(spark, log) == [0, 1, 2, 3, 4]
    assert ids_at(spark, log, 1) == [0, 1]


def ids_at(spark, log, version):
    return sorted(int(r.id) for r in read_log(spark, log, commits.state(spark, log, version)).collect())


def test_two_runs_at_once(spark, tmp_path, monkeypatch):
    """The second run publishes while the first one's model is at work; the first must not add the same cells again."""
    log = str(tmp_path / "log")
    settings = Settings(models=("m",), compression_enabled=False)
    samples = spark.createDataFrame([(str(i), "d", "", "q", "a") for i in range(4)], SAMPLE)
    scorers = Scorers(lambda model: lambda prompts: [["x"] for _ in prompts])
    real, between = append_results, []

    def late(*args):
        if not between:
            between.append(1)
            run_batch(samples, log, scorers, "second", NOW, settings)
        return real(*args)

    monkeypatch.setattr("veritrim.plans.experiment.append_results", late)
    with pytest.raises(commits.ConcurrentCommit):
        run_batch(samples, log, scorers, "first", NOW, settings)
    run_batch(samples, log, scorers, "first", NOW, settings)
    assert {r.run_id for r in read_log(spark, log).collect()} == {"second"} and ids(spark, log) == [0, 1, 2, 3]


def test_manifests_are_snapshots_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT_EVERY", 3)
    path, opened = str(tmp_path / "t"), []
    for i in range(8):
        commits.publish(spark, path, {"files": [{"file": f"f{i}", "bytes": 1}]}, commits.state(spark, path))
    real = commits._read
    monkeypatch.setattr(commits, "_read", lambda s, p, v: opened.append(v) or real(s, p, v))
    assert commits.files_of(commits.state(spark, path)) == [f"f{i}" for i in range(8)]
    assert opened == [8, 7, 6]
    assert commits.files_of(commits.state(spark, path, 4)) == [f"f{i}" for i in range(4 + 0)]
    assert not list((tmp_path / "t" / "_commits").glob(".draft*json"))


def test_a_log_without_manifests_is_taken_over(spark, tmp_path):
    log = str(tmp_path / "log")
    batch(spark, 0, 3).write.partitionBy("dataset").parquet(log)
    assert ids(spark, log) == [0, 1, 2]
    append_results(batch(spark, 3, 1), log)
    assert ids(spark, log) == [0, 1, 2, 3]
    keys = spark.createDataFrame([("0", "d"), ("3", "d")], "id string, dataset string")
    assert {r.id for r in logged_cells_of(spark, log, keys).collect()} >= {"0", "3"}


def test_nothing_to_append(spark, tmp_path):
    log = str(tmp_path / "log")
    assert append_results(batch(spark, 0, 0), log) == 0
    append_results(batch(spark, 0, 1), log)
    assert append_results(batch(spark, 0, 0), log) == 1 and ids(spark, log) == [0]


def test_tables_change_together(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "tables")
    assert read_tables(spark, path) == {}
    publish_tables({"a": spark.range(1), "b": spark.range(2)}, path)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(commits, "data_files", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        publish_tables({"a": spark.range(10), "b": spark.range(20)}, path)
    assert {n: t.count() for n, t in read_tables(spark, path).items()} == {"a": 1, "b": 2}
    publish_tables({"a": spark.range(3)}, path, "csv")
    assert [(n, rows(t)) for n, t in read_tables(spark, path).items()] == [("a", [("0",), ("1",), ("2",)])]


def test_bloom_filters_forget_nothing():
    rng = np.random.default_rng(1)
    held, others = rng.integers(-(1 << 63), 1 << 63, 5000), rng.integers(-(1 << 63), 1 << 63, 2000)
    made = key_index.bloom(held)
    assert all(key_index.may_hold(made, held[i : i + 1]) for i in range(5000))
    assert sum(key_index.may_hold(made, others[i : i + 1]) for i in range(2000)) < 60
    assert not key_index.may_hold(key_index.bloom(held[:0]), held)


def test_segments_are_few(spark):
    sizes = []
    for _ in range(500):
        taken = key_index.to_merge([{"cells": s} for s in sizes], 10)
        sizes = [*sizes[: len(sizes) - taken], 10 + sum(sizes[len(sizes) - taken :])]
    assert sum(sizes) == 5000 and len(sizes) <= 6


def rows_read(spark, action):
    """Rows that the tasks of an action read from files."""
    store = spark._jsc.sc().statusStore()

    def total():
        stages, out = store.stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None), {}
        for i in range(stages.size()):
            s = stages.apply(i)
            out[s.stageId()] = s.inputRecords()
        return out

    before = total()
    result = action()
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    return sum(n for k, n in total().items() if k not in before), result


def test_rows_read_for_a_batch_do_not_follow_the_log(spark, tmp_path):
    log = str(tmp_path / "log")
    settings = Settings(models=("m",), compression_enabled=False)

    def pending(first, n):
        samples = spark.createDataFrame([(str(i), "d") for i in range(first, first + n)], "id string, dataset string")
        grid = condition_grid(samples, settings)
        return pending_cells(grid, logged_cells_of(spark, log, samples)).count()

    made = lambda first, n: (
        spark.range(first, first + n).select(
            F.col("id").cast("string").alias("id"), F.lit("d").alias("dataset"), F.lit("m").alias("model_name"), F.lit(0).alias("requested_mode"),
            *[F.lit(None).cast(t).alias(c) for c, t in (("compressed", "int"), ("orig_tokens", "int"), ("compressed_tokens", "int"), ("prediction", "string"),
              ("exact_match", "double"), ("keyword_match", "double"), ("self_consistency", "double"), ("nli_support", "double"), ("hallucination", "double"),
              ("run_id", "string"), ("timestamp", "timestamp"), ("batch_id", "long"))],
        )
    )
    append_results(made(0, 40_000), log)
    small, found = rows_read(spark, lambda: pending(10_000_000, 300))
    assert found == 300
    append_results(made(40_000, 200_000), log)
    append_results(made(240_000, 160_000), log)
    assert read_log(spark, log).count() == 400_000
    large, found = rows_read(spark, lambda: pending(10_000_000, 300))
    assert found == 300
    # One row for each bucket and its filter, none of the log: not a thousandth of its rows, and no more of a log ten times as long
    # but for the buckets it has more.
    assert small <= 40 and large <= 80
    again, found = rows_read(spark, lambda: pending(399_000, 2000))
    assert found == 1000 and again <= 160


def test_stored_manifest_is_plain_json(spark, tmp_path):
    log = str(tmp_path / "log")
    append_results(batch(spark, 0, 2), log, "run", 7)
    (held,) = [json.loads(f.read_text()) for f in (tmp_path / "log" / "_commits").glob("0*.json")]
    assert held["entry"]["run_id"] == "run" and held["entry"]["batch_id"] == 7 and held["entry"]["files"][0]["bytes"] > 0
