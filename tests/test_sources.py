import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.helpers import log_rows, rows
from veritrim.operators.aggregates import experiment_summary
from veritrim.operators.results import result_rows
from veritrim.plans.analysis import TABLES, analyse, post_hoc_deltas
from veritrim.schemas import RESULT, SAMPLE
from veritrim.sources.readers import good_rows, load_results, read_jsonl, read_log, rejected_lines
from veritrim.sources.writers import append_results, export_results_csv, write_samples, write_summary

SAMPLE_LINE = {"id": "a", "dataset": "d", "context": "", "question": "q", "answer": "x"}
HEADER = ",".join(RESULT.names)


def test_jsonl_skips_blank_lines_and_keeps_rejects(spark, tmp_path):
    one, two = tmp_path / "one.jsonl", tmp_path / "two.jsonl"
    one.write_text(
        "\n".join(
            [
                json.dumps(SAMPLE_LINE),
                "",
                "   ",
                "{broken",
                json.dumps({"id": 5, "question": "é\n", "extra": 1}),
                json.dumps(SAMPLE_LINE | {"id": "n", "context": None}),
            ]
        ),
        encoding="utf-8",
    )
    two.write_text(json.dumps(SAMPLE_LINE | {"id": "b"}) + "\nnot json\n", encoding="utf-8")
    lines = read_jsonl(spark, [str(one), str(two)])
    good = good_rows(lines)
    assert rows(good.select("id", "dataset", "context", "question")) == rows(
        spark.createDataFrame(
            [("a", "d", "", "q"), ("5", None, None, "é\n"), ("n", "d", None, "q"), ("b", "d", "", "q")],
            "id string, dataset string, context string, question string",
        )
    )
    rejects = rejected_lines(lines).collect()
    assert sorted(r.line.strip() for r in rejects) == ["not json", "{broken"]
    assert {r.source_file.rsplit("/", 1)[1] for r in rejects} == {"one.jsonl", "two.jsonl"}


def test_samples_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("1", "d", "", "line\nbreak \"q\"", "é"), ("2", "d", None, "q", "")], SAMPLE)
    write_samples(samples, str(tmp_path / "s"))
    back = good_rows(read_jsonl(spark, str(tmp_path / "s"))).select(*SAMPLE.names)
    assert rows(back) == rows(samples)


def test_results_missing_empty_and_header_only(spark, tmp_path):
    assert load_results(spark, str(tmp_path / "absent.csv")).count() == 0
    (tmp_path / "empty.csv").write_text("")
    assert load_results(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "header.csv").write_text(HEADER + "\n")
    loaded = load_results(spark, str(tmp_path / "header.csv"))
    assert loaded.count() == 0 and loaded.columns == RESULT.names


def test_results_defaults_and_lenient_numbers(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,compressed,nli_support,model_name\n7,1.0,bad,m\n8,,0.25,m\n")
    a, b = load_results(spark, str(path)).orderBy("id").collect()
    assert (a.id, a.dataset, a.compressed, a.nli_support, a.prediction, a.orig_tokens) == ("7", "unknown", 1, 0.0, "", 0)
    assert (b.compressed, b.nli_support, b.timestamp) == (0, 0.25, None)


def test_results_with_newlines_and_quotes(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        HEADER + '\n1,d,m,0,5,5,"line one\nsaid ""hi"", then",1.0,1.0,1.0,0.9,0.0,run,2024-01-02T03:04:05.123456\n'
    )
    (r,) = load_results(spark, str(path)).collect()
    assert r.prediction == 'line one\nsaid "hi", then'
    assert r.timestamp == datetime(2024, 1, 2, 3, 4, 5, 123456)


def test_strict_results_fail_on_a_bad_number(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("id,compressed,nli_support,hallucination\n1,0,0.5,0\n1,1,0.75,0\n")
    stats = post_hoc_deltas(spark, str(path)).first()
    assert (stats.total, stats.improved, stats.avg_delta_nli) == (1, 1, 0.25)
    path.write_text("id,compressed,nli_support,hallucination\n1,0,bad,0\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_results(spark, str(path), strict=True).collect()
    for bad in ("0,bad,0", "0,0.5,bad", "x,0.5,0"):
        path.write_text(f"id,compressed,nli_support,hallucination,orig_tokens\n1,{bad},7\n1,1,0.75,0,8\n")
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            post_hoc_deltas(spark, str(path)).collect()
    path.write_text("id,compressed,nli_support,hallucination,orig_tokens\n1,0,0.5,0,many\n1,1,0.75,0,8\n")
    assert post_hoc_deltas(spark, str(path)).first().total == 1


def test_lines_with_single_quotes_or_more_than_an_object_are_rejected(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    good = '{"id": "1", "question": "a } b ] c"}'
    lines = [good, "{'id': '2', 'question': 'q'}", '{"id": "3", "question": "q"} trailing', '{"id": "4"} {"id": "5"}', '{"id": "6"},{"id": "7"}']
    path.write_text("\n".join([*lines, "[1]", "5", '"text"', "{", '  {"id": "8", "question": "q"}  ']))
    read = read_jsonl(spark, str(path))
    assert sorted(r.id for r in good_rows(read).collect()) == ["1", "8"]
    assert rejected_lines(read).count() == 8


def test_log_appends_and_csv_round_trip(spark, tmp_path):
    log = str(tmp_path / "log")
    assert read_log(spark, log).count() == 0
    batch = log_rows(spark, [{"id": "1", "prediction": 'a\n"b", c'}, {"id": "2", "prediction": ""}]).withColumns(
        {"compressed_tokens": F.lit(1), "requested_mode": F.lit(0)}
    )
    for i in (0, 1):
        append_results(result_rows(batch, "run", F.lit(datetime(2024, 1, 1)), i), log)
    stored = read_log(spark, log)
    assert stored.count() == 4 and {r.batch_id for r in stored.collect()} == {0, 1}
    assert (tmp_path / "log" / "dataset=d").is_dir()

    export_results_csv(stored, str(tmp_path / "csv"))
    back = load_results(spark, str(tmp_path / "csv"))
    assert rows(back.select("id", "prediction")) == rows(stored.select("id", "prediction"))


def test_summary_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "summary")
    log = log_rows(spark, [{"nli_support": 1 / 3}, {"compressed": 1, "nli_support": 0.5}])
    for _ in range(2):
        write_summary(experiment_summary(log), path)
    table = spark.read.option("header", True).csv(path)
    assert table.columns == [
        "group", "count", "avg_exact_match", "avg_keyword_match", "avg_self_consistency", "avg_nli_support", "hallucination_rate",
    ]
    assert {(r.group, r.avg_nli_support) for r in table.collect()} == {
        ("overall", "0.4167"), ("dataset=d", "0.4167"), ("compressed=0", "0.3333"), ("compressed=1", "0.5"),
    }


def test_analysis_writes_all_tables(spark, tmp_path):
    log = log_rows(
        spark,
        [
            {"model_name": m, "id": str(i), "compressed": c, "nli_support": 0.1 * (i + c), "timestamp": datetime(2024, 1, 1)}
            for m in ("phi-3", "mistral")
            for i in range(3)
            for c in (0, 1)
        ],
    )
    analyse(log, str(tmp_path), tiebreak=["n"])
    for name in TABLES:
        assert spark.read.option("header", True).csv(str(tmp_path / name)).count() > 0
    wide = spark.read.option("header", True).csv(str(tmp_path / "delta_metrics_model_dataset"))
    assert wide.columns == [
        "model_name", "dataset", "hallucination_0", "hallucination_1", "nli_support_0", "nli_support_1", "delta_nli", "delta_hallucination",
    ]
    assert {round(float(r.delta_nli), 6) for r in wide.collect()} == {0.1}


def test_the_last_row_in_file_order_stays(spark, tmp_path):
    """A log without times: text order and file order differ, in one file and over several."""
    from veritrim.operators.aggregates import clean_log
    from veritrim.operators.dedup import keep_last

    head = "id,dataset,model_name,compressed,prediction,nli_support,hallucination\n"
    (tmp_path / "a.csv").write_text(head + '1,d,m,0,zzz first,0.9,0\n2,d,m,0,"two\nlines",0.5,0\n1,d,m,0,aaa last,0.1,1\n')
    (tmp_path / "b.csv").write_text(head + "2,d,m,0,A in the second file,0.2,1\n")
    log = load_results(spark, str(tmp_path / "*.csv"), with_order=True)
    kept = {r.id: r.prediction for r in keep_last(log, time_col=None).collect()}
    assert kept == {"1": "aaa last", "2": "A in the second file"}
    # Times that are missing everywhere, as in the analysis of such a log, leave it to the order as well.
    assert {r.id: r.prediction for r in clean_log(log).collect()} == kept
    assert {r.id: r.prediction for r in clean_log(log.repartition(5)).collect()} == kept
    many = "".join(f"{i % 50},d,m,0,{(i * 7919) % 1000},0.5,0\n" for i in range(5000))
    (tmp_path / "c.csv").write_text(head + many)
    log = load_results(spark, str(tmp_path / "c.csv"), with_order=True)
    assert {int(r.id): r.prediction for r in keep_last(log, time_col=None).collect()} == {i % 50: str((i * 7919) % 1000) for i in range(5000)}
    empty = load_results(spark, str(tmp_path / "none.csv"), with_order=True)
    assert keep_last(empty, time_col=None).collect() == []


def test_commits_are_read_in_their_order(spark, tmp_path):
    from veritrim.operators.dedup import FILE_ORDER, keep_last

    log = str(tmp_path / "log")
    for i in range(6):
        row = log_rows(spark, [{"prediction": "zyxwvu"[i]}]).withColumns({"compressed_tokens": F.lit(1), "requested_mode": F.lit(0)})
        append_results(result_rows(row, "run", F.lit(datetime(2024, 1, 1)), 0), log)
    read = read_log(spark, log, with_order=True)
    assert [r.prediction for r in read.orderBy(FILE_ORDER).collect()] == list("zyxwvu")
    assert [r.prediction for r in keep_last(read.drop("timestamp"), time_col=None).collect()] == ["u"]
    assert read_log(spark, str(tmp_path / "nothing"), with_order=True).collect() == []
