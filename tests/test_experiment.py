from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.helpers import rows
from veritrim.functions.prompts import model_cap
from veritrim.functions.tokenizers import token_counter, token_shortener, token_truncator
from veritrim.operators.inference import Packing, packs, score_batches
from veritrim.operators.results import full_support
from veritrim.plans.experiment import Scorers, batch_counters, generate, plan_cells, run_batch, run_report, score_cells
from veritrim.schemas import RESULT_LOG, SAMPLE, Settings
from veritrim.sources.readers import no_rows, read_log

NOW = datetime(2024, 1, 1)
SETTINGS = Settings(models=("good", "broken"), compression_threshold=5, retry_tokens=3)


def load(model_name):
    if model_name == "broken":
        raise OSError("no weights")

    def predict(prompts):
        if any("poison" in p for p in prompts):
            raise ValueError("poison " + "x" * 300)
        return [RuntimeError("CUDA out of memory") if len(p.split()) > 30 else [p.split()[-1]] for p in prompts]

    return predict


def load_all(model_name):
    return load("good")


@pytest.fixture
def samples(spark):
    return spark.createDataFrame(
        [
            ("1", "d", "", "short?", "Answer"),
            ("2", "d", "ctx " * 40, "long?", "Answer"),
            ("3", "d", "", "poison", "Answer"),
            ("4", None, None, "again", None),
            ("4", None, None, "again", None),
            (None, "d", "", "lost", ""),
        ],
        SAMPLE,
    )


def test_plan_cells(spark, samples):
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), SETTINGS)
    got = {(r.id, r.model_name, r.requested_mode): r for r in cells.collect()}
    assert len(got) == cells.count() == 4 * 2 * 2
    short, long = got["2", "good", 1], got["2", "good", 0]
    assert (short.compressed, short.compressed_tokens, long.compressed) == (1, 5, 0)
    assert short.orig_tokens == long.orig_tokens == long.compressed_tokens == len(long.prompt.split())
    assert got["4", "good", 0].dataset == "unknown"


def test_failures_stay_in_their_rows(spark, samples):
    plain = Settings(models=("good", "broken"), compression_enabled=False, retry_tokens=3)
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), plain)
    made = {(r.id, r.model_name): r for r in generate(cells, load, plain).collect()}
    assert made["1", "good"].responses == ["Answer:"] and made["1", "good"].error is None
    # Out of memory: tried again with three tokens, which are counted.
    retried = made["2", "good"]
    assert (retried.responses, retried.prompt, retried.compressed_tokens) == (["ctx"], "Context: ctx ctx", 3)
    assert retried.orig_tokens > 30
    assert made["3", "good"].error.type == "ValueError" and made["3", "good"].responses is None
    assert all(made[i, "broken"].error.unavailable for i in "1234")

    scored = {(r.id, r.model_name): r for r in score_cells(generate(cells, load, plain), Scorers(load), plain).collect()}
    assert {m for _, m in scored} == {"good"}
    mark = scored["3", "good"]
    assert mark.prediction == "[SKIPPED_ERROR] ValueError: poison " + "x" * 173
    assert (mark.exact_match, mark.nli_support, mark.hallucination, mark.compressed) == (0.0, 0.0, 1.0, 0)
    assert scored["1", "good"].exact_match == 1.0


def test_no_retry_when_nothing_can_be_cut(spark):
    df = spark.createDataFrame([("a b",)], "prompt string")
    fail = lambda model: lambda prompts: [RuntimeError("out of memory") for _ in prompts]
    (r,) = score_batches(df, fail, "prompt", "out", T.StringType(), shorten=lambda p: p).collect()
    assert r.error.message == "out of memory" and r.out is None


def test_tasks_see_few_models_and_processes_keep_theirs(spark, tmp_path):
    seen = str(tmp_path)

    def load_counted(model):
        import os
        import uuid

        open(os.path.join(seen, f"{model}-{uuid.uuid4().hex}"), "w").close()
        return lambda prompts: [model for _ in prompts]

    df = spark.range(0, 4000, 1, 2).select(
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model_name"), F.col("id").cast("string").alias("p")
    )
    out = score_batches(df, load_counted, "p", "said", T.StringType(), model_col="model_name", tasks=64)
    assert out.filter(F.col("said") == F.col("model_name")).count() == 4000
    # Eight processes, which mostly go from one model to the next: far fewer loads than tasks or than tasks x models.
    assert len(list(tmp_path.iterdir())) <= 8 * 3


def test_outputs_that_are_missing_are_errors(spark):
    df = spark.range(0, 20, 1, 1).select(F.col("id").cast("string").alias("p"))
    short = lambda model: lambda prompts: [p for p in prompts if p != "7"]
    got = {r.p: (r.out, r.error) for r in score_batches(df, short, "p", "out", T.StringType()).collect()}
    assert got["7"][0] is None and got["7"][1].type == "ValueError"
    assert all(out == p and error is None for p, (out, error) in got.items() if p != "7")


def test_a_failing_batch_is_halved(spark):
    calls = []

    def predict(prompts):
        calls.append(len(prompts))
        if 3 in prompts:
            raise ValueError("bad row")
        return prompts

    from veritrim.operators.inference import _attempt

    assert [isinstance(x, ValueError) for x in _attempt(predict, list(range(64)))] == [i == 3 for i in range(64)]
    assert len(calls) < 16


def test_neural_stages_feed_the_closed_forms(spark, samples):
    plain = Settings(models=("good",), compression_enabled=False, responses_per_cell=2)
    cells = plan_cells(samples.filter("id = '1'"), no_rows(spark, RESULT_LOG), plain)
    scorers = Scorers(
        generate=lambda m: lambda prompts: [["a", "b"] for _ in prompts],
        embed=lambda _: lambda answers: [[[1.0, 0.0], [0.0, 1.0]] for _ in answers],
        entail=lambda _: lambda pairs: [[0.0, 0.0, 0.0] for _ in pairs],
    )
    (r,) = score_cells(generate(cells, scorers.generate, plain), scorers, plain).collect()
    assert r.self_consistency == pytest.approx(0.0) and r.nli_support == pytest.approx(1 / 3)
    assert r.hallucination == 1.0


def test_rerun_adds_only_what_is_missing(spark, samples, tmp_path):
    log = str(tmp_path / "log")
    scorers = Scorers(generate=load, support=full_support)
    run_batch(samples, log, scorers, "run1", NOW, SETTINGS, 0)
    first = read_log(spark, log)
    # Four samples in two modes; the rows of the model without weights are not written.
    assert first.count() == 8 and {r.model_name for r in first.collect()} == {"good"}
    counters = batch_counters(samples, first, "run1", 0, SETTINGS).first()
    assert (counters.written, counters.skipped, counters.errors) == (8, 0, 2)  # the poisoned sample fails in both modes

    run_batch(samples, log, Scorers(generate=load_all, support=full_support), "run2", NOW, SETTINGS, 1)
    second = read_log(spark, log)
    assert second.count() == 16
    assert second.groupBy("id", "dataset", "model_name", "requested_mode").count().filter("count > 1").count() == 0
    counters = batch_counters(samples, second, "run2", 1, SETTINGS).first()
    assert (counters.written, counters.skipped) == (8, 8)

    # Batch numbers start again with each run.
    third = second.withColumn("batch_id", F.lit(0).cast("bigint"))
    counters = batch_counters(samples, third, "run2", 0, SETTINGS).first()
    assert (counters.written, counters.skipped) == (8, 8)

    before = rows(second)
    run_batch(samples, log, scorers, "run3", NOW, SETTINGS, 2)
    assert rows(read_log(spark, log)) == before
    report = run_report(second)
    assert report["delta_stats"].first().total > 0 and report["experiment_summary"].count() == 5


def test_counts_by_a_given_tokenizer(spark, samples):
    counted = Settings(
        models=("good",), compression_threshold=5, retry_tokens=3, count_tokens=token_counter(lambda: lambda text: list(text))
    )
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), counted)
    for r in cells.collect():
        assert r.compressed_tokens == len(r.prompt) and (r.requested_mode == 1 or r.orig_tokens == len(r.prompt))
    for r in generate(cells, load, counted).collect():
        assert r.compressed_tokens == len(r.prompt)


def test_windows_tokenizers_answers_and_pairs(spark):
    """Cuts by a tokenizer of letters: its limits hold in every stage."""
    codec = lambda: (list, "".join)
    letters = Settings(
        models=("a", "b"), compression_enabled=False, responses_per_cell=2, windows={"a": 30 + 64 + 8}, premise_tokens=20, pair_tokens=12,
        count_tokens=token_counter(lambda: list), truncate=token_truncator(codec), shorten=token_shortener(codec), retry_tokens=10,
    )
    def load_asked(model, wanted):
        assert (wanted.answers, wanted.sampled) == (2, True)
        return lambda prompts: [RuntimeError("out of memory") if len(p) > 40 else [f" {len(p)}\n", "y", "z"] for p in prompts]

    df = spark.createDataFrame([("1", "d", "c" * 50, "q", "g")], SAMPLE)
    made = {r.model_name: r for r in generate(plan_cells(df, no_rows(spark, RESULT_LOG), letters), load_asked, letters).collect()}
    assert made["a"].responses == ["30", "y"] and len(made["a"].prompt) == 30
    assert made["b"].responses == ["10", "y"] and made["b"].compressed_tokens == 10
    scorers = Scorers(load_asked, entail=lambda _: lambda pairs: [[0.0, 0.0, float(len(p) == 12 - len(a))] for p, a in pairs])
    scored = score_cells(generate(plan_cells(df, no_rows(spark, RESULT_LOG), letters), load_asked, letters), scorers, letters)
    assert {round(r.nli_support, 3) for r in scored.collect()} == {0.576}


def test_a_compressor_that_cannot_be_loaded_leaves_prompts_alone(spark, samples):
    def broken(_):
        raise OSError("no compressor")

    run = Settings(models=("good",), compression_threshold=1)
    cut = lambda _: lambda prompts: [p[:4] for p in prompts]
    whole = {r.id: r for r in plan_cells(samples, no_rows(spark, RESULT_LOG), run, compressor=broken).collect() if r.requested_mode}
    short = {r.id: r for r in plan_cells(samples, no_rows(spark, RESULT_LOG), run, compressor=cut).collect() if r.requested_mode}
    assert all((r.compressed, r.orig_tokens, r.compressed_tokens) == (0, 0, 0) for r in whole.values())
    assert all(r.compressed == 1 and r.prompt == whole[i].prompt[:4] for i, r in short.items())


def test_the_compressor_gets_its_target(spark, samples):
    def load_compressor(_, wanted):
        return lambda prompts: [" ".join(p.split()[: wanted.target_tokens]) for p in prompts]

    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), SETTINGS, compressor=load_compressor)
    got = {(r.id, r.requested_mode): r for r in cells.collect()}
    assert got["2", 1].prompt == "Context: ctx ctx ctx ctx" and got["2", 1].compressed_tokens == 5


def test_packs_are_full_and_bounded():
    lengths = [3, 1, 50, 4, 4, 0, 9, 2, 200, 3]
    made = packs(lengths, 20)
    assert sorted(i for p in made for i in p) == list(range(10))
    for p in made:
        assert len(p) == 1 or max(lengths[i] for i in p) * len(p) <= 20
    assert made[:2] == [[8], [2]] and len(made) == 5
    assert packs([], 20) == [] and packs([0, 0, 0], 2) == [[0, 1], [2]]


def test_calls_are_packed_and_equal_prompts_answered_once(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load_counted(model):
        import os
        import uuid

        def predict(prompts):
            longest = max(len(p.split()) for p in prompts)
            os.makedirs(calls, exist_ok=True)
            with open(os.path.join(calls, uuid.uuid4().hex), "w") as out:
                out.write(f"{len(prompts)} {longest * len(prompts)} {sum(len(p.split()) for p in prompts)}")
            return [f"{model}:{p}" for p in prompts]

        return predict

    rows_ = [(f"m{i % 2}", " ".join(["w"] * (1 + (i * 37) % 90)) + f" {i % 400}") for i in range(2400)]
    df = spark.createDataFrame(rows_, "model_name string, p string")
    batch_size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
        made = score_batches(df, load_counted, "p", "said", T.StringType(), "model_name", tasks=4, packing=Packing(500)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_size)
    assert len(made) == 2400 and all(r.said == f"{r.model_name}:{r.p}" for r in made)
    sizes = [tuple(map(int, f.read_text().split())) for f in (tmp_path / "calls").iterdir()]
    assert sum(n for n, *_ in sizes) == len(set(rows_))
    assert all(padded <= 500 for _, padded, _ in sizes)
    # In the order of arrival, padding would about double the tokens.
    assert sum(padded for _, padded, _ in sizes) < 1.35 * sum(own for *_, own in sizes)


def test_packed_run_equals_a_plain_one(spark, samples):
    plain = Settings(models=("good", "broken"), compression_enabled=False, retry_tokens=3)
    packed = replace(plain, batch_tokens=40)
    cells = plan_cells(samples, no_rows(spark, RESULT_LOG), plain)
    columns = ["id", "model_name", "prompt", "responses", "compressed_tokens", "error.type"]
    assert rows(generate(cells, load, packed).select(*columns)) == rows(generate(cells, load, plain).select(*columns))


def test_subword_tokens_as_the_library_counts_them(spark):
    from veritrim.catalog.prompts import WITHOUT_SQL, byte_pairs

    encode, decode = byte_pairs()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coded = {d: encode(t or "") for d, (t, _) in texts.items()}
    assert {r.doc_id: r.tokens for r in WITHOUT_SQL["token_count_bpe"](spark, sf).collect()} == {d: len(c) for d, c in coded.items()}
    caps = {"en": 600 - 72, "fr": 2048 - 72, "es": 4096 - 72, "de": 1024 - 72}
    cut = 0
    for r in WITHOUT_SQL["input_window_bpe"](spark, sf).collect():
        ids, cap = coded[r.doc_id], caps.get(texts[r.doc_id][1], 4096 - 72)
        cut += len(ids) > cap
        want = (cap, decode(ids[:cap]) if len(ids) > cap else texts[r.doc_id][0], min(len(ids), cap), len(ids) >= cap)
        assert (r.cap, r.prompt, r.tokens, r.truncated) == want
    assert cut > 5


def test_the_tokenizers_window_is_the_second_choice(spark):
    settings = Settings(windows={"a": 1000}, tokenizer_windows={"a": 500, "b": 600, "c": 0})
    caps = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "m string").select("m", model_cap(F.col("m"), settings).alias("cap"))
    assert dict(map(tuple, caps.collect())) == {"a": 928, "b": 528, "c": 4024, "d": 4024}


def test_null_prompts_have_no_subword_tokens(spark):
    from veritrim.catalog.prompts import byte_pairs
    from veritrim.functions.tokenizers import token_fitter

    fit = token_fitter(byte_pairs)(F.col("t"), 2)
    got = spark.createDataFrame([(None,), ("",), ("one two three",)], "t string").select(fit.alias("f")).select("f.*").collect()
    assert [tuple(r) for r in got] == [(None, 0, False), ("", 0, False), ("one two", 2, True)]
