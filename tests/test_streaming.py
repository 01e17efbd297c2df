import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import log_rows, rows
from veritrim.operators.aggregates import experiment_summary
from veritrim.operators.results import result_rows
from veritrim.plans.experiment import Scorers
from veritrim.schemas import RESULT_LOG, SAMPLE, Settings
from veritrim.sources.readers import read_log
from veritrim.sources.writers import append_results
from veritrim.streaming.jobs import read_summary, score_stream, summary_stream

NOW = datetime(2024, 1, 1)
SETTINGS = Settings(models=("m",), compression_enabled=False)


def load(model_name):
    return lambda prompts: [ValueError("bad") if "bad" in p else ["x"] for p in prompts]


def test_each_cell_is_scored_once_across_restarts(spark, tmp_path):
    arriving, log = tmp_path / "in", str(tmp_path / "log")
    arriving.mkdir()

    def arrive(name, ids):
        lines = [json.dumps({"id": i, "dataset": "d", "question": "bad" if i == "2" else "q"}) for i in ids]
        (arriving / name).write_text("\n".join(lines))

    def run(checkpoint):
        samples = spark.readStream.schema(SAMPLE).json(str(arriving))
        score_stream(samples, log, str(tmp_path / checkpoint), Scorers(load), "run", NOW, SETTINGS).awaitTermination()
        return sorted((r.id, r.batch_id) for r in read_log(spark, log).collect())

    arrive("a.json", ["1", "2"])
    assert run("c1") == [("1", 0), ("2", 0)]
    assert run("c1") == [("1", 0), ("2", 0)]
    # A new file that repeats a key, and a failed key: both are done already.
    arrive("b.json", ["1", "2", "3"])
    assert run("c1") == [("1", 0), ("2", 0), ("3", 1)]
    # A lost checkpoint: every file comes again, the log still holds every key.
    assert run("c2") == [("1", 0), ("2", 0), ("3", 1)]
    marks = {r.id: r.prediction for r in read_log(spark, log).collect()}
    assert marks["2"].startswith("[SKIPPED_ERROR] ValueError") and marks["1"] == "x"


def test_running_summary_equals_the_batch_summary(spark, tmp_path):
    log, summary = str(tmp_path / "log"), str(tmp_path / "summary")

    def append(batch, items):
        df = log_rows(spark, items).withColumns({"compressed_tokens": F.lit(1), "requested_mode": F.lit(0)})
        append_results(result_rows(df, "run", F.lit(NOW), batch), log)

    def run():
        stream = spark.readStream.schema(RESULT_LOG).parquet(log)
        summary_stream(stream, summary, str(tmp_path / "checkpoint")).awaitTermination()
        assert rows(read_summary(spark, summary)) == rows(experiment_summary(read_log(spark, log)))

    append(0, [{"nli_support": 0.25}, {"compressed": 1, "nli_support": 0.5}])
    run()
    append(1, [{"dataset": "e", "nli_support": 1.0, "hallucination": 1.0}])
    run()
    assert read_summary(spark, summary).filter("group = 'overall'").first()["count"] == 3


def test_a_stream_with_compression_needs_frequencies(spark, tmp_path):
    samples = spark.readStream.schema(SAMPLE).json(str(tmp_path))
    with pytest.raises(ValueError, match="frequencies"):
        score_stream(samples, str(tmp_path / "log"), str(tmp_path / "c"), Scorers(load), "run", NOW, Settings(models=("m",)))


def test_frequencies_grow_with_the_stream(spark, tmp_path):
    from veritrim.operators.compress import token_frequencies
    from veritrim.sources import commits
    from veritrim.streaming.frequencies import growing_frequencies

    path = str(tmp_path / "counts")
    batches = [[""], *[[f"a b w{i}", f"a {'c ' * i}"] for i in range(12)]]
    frames = [spark.createDataFrame([(t,) for t in b], "prompt string") for b in batches]
    for i, frame in enumerate(frames):
        got = growing_frequencies(frame, "prompt", path, "stream", i)
        if i in (0, 5):
            # Repeated after a failure: not counted twice.
            got = growing_frequencies(frame, "prompt", path, "stream", i)
    corpus = spark.createDataFrame([(t,) for b in batches for t in b], "prompt string")
    assert rows(got) == rows(token_frequencies(corpus, "prompt"))
    assert len(commits.state(spark, path)["entries"]) <= 4


def test_a_stream_with_growing_frequencies_equals_a_batch(spark, tmp_path):
    """In one batch, all samples are known when they are compressed; in two, the second one's prompts see both."""
    settings = Settings(models=("m",), compression_threshold=8)
    arriving = tmp_path / "in"
    arriving.mkdir()

    def arrive(name, lines):
        (arriving / name).write_text("\n".join(json.dumps({"id": i, "dataset": "d", "question": q}) for i, q in lines))

    def run(name):
        samples = spark.readStream.schema(SAMPLE).json(str(arriving))
        query = score_stream(
            samples, str(tmp_path / f"log-{name}"), str(tmp_path / f"c-{name}"), Scorers(load_last), "run", NOW, settings, str(tmp_path / f"f-{name}")
        )
        query.awaitTermination()
        return {(r.id, r.requested_mode): r.prediction for r in read_log(spark, str(tmp_path / f"log-{name}")).collect()}

    arrive("a.json", [(str(i), f"{'x ' * i} one{i} two{i} three four") for i in range(12)])
    first = run("two")
    arrive("b.json", [(str(i), f"{'y ' * i} one{i % 3} four x y") for i in range(12, 20)])
    both, at_once = run("two"), run("one")
    assert {k: v for k, v in both.items() if k in first} == first
    late = [k for k in both if int(k[0]) >= 12]
    assert len(late) == 16 and all(both[k] == at_once[k] for k in late)


def load_last(model_name):
    return lambda prompts: [[p] for p in prompts]
