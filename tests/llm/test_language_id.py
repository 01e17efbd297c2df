"""Forward-backward against all label sequences; held-out accuracy; odd texts."""

import itertools

import numpy as np

from veritrim.llm import language_id as L
from veritrim.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 1, 4])
    scores, moves = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, expected = L.forward_backward(scores, lengths, moves)
    transitions, begin = np.zeros((3, 3)), 0
    for n in lengths:
        part, want, total, pairs = scores[begin : begin + n], np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            steps = list(itertools.pairwise(path))
            p = np.exp(sum(part[i, y] for i, y in enumerate(path)) + sum(moves[s] for s in steps))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
            for s in steps:
                pairs[s] += p
        assert np.allclose(got[begin : begin + n], want / total)
        transitions += pairs / total
        begin += n
    assert np.allclose(expected, transitions)


def test_held_out_accuracy_and_labels(spark):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id].lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark):
    model = L.fit(["the house and the tree stand here"] * 3 + ["das haus und der baum stehen hier"] * 3, ["en"] * 3 + ["de"] * 3)
    rows = [(1, None), (2, ""), (3, "123 !? 4.5"), (4, "the house " * 30_000), (5, "das haus"), (5, "das haus"), (None, "the tree and das haus und der baum")]
    df = spark.createDataFrame([(*r, "x", 7.0) for r in rows], "doc_id long, text string, lang_pred string, score double")
    got = L.predict(df, model).collect()
    by = {r.doc_id: (r.lang_pred, round(r.score, 3)) for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "de"
    nothing = L.predict(df.filter("false"), model)
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "text", "lang_pred", "score"]
    assert {r.lang_pred for r in L.predict(df, L.fit([], [])).collect()} == {"und"}


def test_words_switch_inside_a_text():
    model = L.fit(["the house and the tree stand here and there"] * 5 + ["das haus und der baum stehen hier und dort"] * 5, ["en"] * 5 + ["de"] * 5)
    words = "the house and the tree das haus und der baum".split()
    posterior, _ = L.forward_backward(model.emissions(words), np.array([10]), model.transitions)
    assert [model.labels[i] for i in posterior.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5
