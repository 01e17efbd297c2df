from collections import Counter

import pytest

from tests.helpers import rows
from veritrim.operators.compress import _candidates, compress_to_budget, token_frequencies
from veritrim.operators.skew import frequent_keys


def brute_force(texts, budget):
    freq = Counter(w for t in texts.values() for w in t.split())
    out = []
    for key, t in texts.items():
        words = t.split()
        if len(words) <= budget:
            out.append((key, t, len(words), len(words)))
            continue
        kept = sorted(sorted(range(len(words)), key=lambda i: (freq[words[i]], i))[:budget])
        out.append((key, " ".join(words[i] for i in kept), len(words), budget))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts(spark):
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    data = {r.doc_id: r.text for r in some.collect()}
    # One word holds most of the corpus; empty texts and texts at the budget are there as well.
    data |= {-1: "the " * 5000 + "rare", -2: "", -3: "  a  b\nc ", -4: " \t" * 60, -5: "x" * 500}
    return data


@pytest.mark.parametrize("budget, frequent", [(3, 1), (64, 100), (64, 10_000)])
@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_equals_brute_force(spark, texts, budget, frequent, broadcast):
    """Also with every size-based broadcast turned off, as for a large vocabulary."""
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        assert rows(compress_to_budget(df, ["doc_id"], "text", budget, most_frequent_tokens=frequent)) == brute_force(texts, budget)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_given_frequencies(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "d")], "k int, text string")
    corpus = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "token string, freq bigint")
    got = compress_to_budget(df, ["k"], "text", 2, corpus)
    assert rows(got) == [(1, "a d", 4, 2), (2, "d", 1, 1)]


def test_tokens_of_a_tokenizer(spark):
    """Whole result of the registered query against the plain library call."""
    from veritrim.catalog.prompts import BUDGET, WITHOUT_SQL, byte_pairs

    encode, decode = byte_pairs()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    coded = {k: encode(t or "") for k, t in texts.items()}
    freq = Counter(i for ids in coded.values() for i in ids)
    want = []
    for k, ids in coded.items():
        kept = sorted(sorted(range(len(ids)), key=lambda i: (freq[ids[i]], i))[:BUDGET])
        want.append((k, texts[k] if len(ids) <= BUDGET else decode([ids[i] for i in kept]), len(ids), len(kept)))
    assert rows(WITHOUT_SQL["compress_with_tokenizer"](spark, sf)) == sorted(want, key=str)


def test_null_text_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 9), (2, "a b c", "y", 9)], "k int, text string, token string, freq int")
    assert rows(compress_to_budget(df, ["k"], "text", 2)) == [(1, None, 0, 0), (2, "a b", 3, 2)]


def test_a_texts_tokens_are_not_all_shuffled(spark):
    """Each token went through four shuffles; now only those that are not frequent go, through two."""
    words = [f"w{i}" for i in range(200)]
    df = spark.createDataFrame([(k, " ".join(words[(k * 7 + i) % 200] for i in range(300)) + f" own{k}") for k in range(400)], "k int, text string")
    plan = compress_to_budget(df, ["k"], "text", 5)
    assert "posexplode" not in plan._jdf.queryExecution().optimizedPlan().toString()
    sent = _candidates(df.selectExpr("k", "text as prompt", "split(text, ' ') as _words"), ["k"], 5, frequent_keys(token_frequencies(df, "text"), "freq", 200))
    assert sent.filter("token is not null").count() == 400
    assert [r.n for r in sent.filter("token is null").selectExpr("size(_head.known) as n").distinct().collect()] == [4]


def test_the_most_frequent_keys_are_told_whatever_their_share(spark):
    """Before, a key needed one ``most``-th of all rows, so that of many keys hardly any was frequent."""
    counts = spark.createDataFrame([(f"t{i}", 1000 - i) for i in range(500)] + [(f"r{i}", 1) for i in range(5000)], "token string, freq long")
    found = {r.token: r.freq for r in frequent_keys(counts, "freq", 400).collect()}
    assert 300 < len(found) <= 400 and min(found.values()) > 1000 - 401


def test_pieces_equal_the_whole_text(spark):
    """The held pieces of texts give the ids of the plain library call, also for odd white space and added tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from veritrim.catalog.prompts import byte_pairs

    encode, decode = byte_pairs()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", " ", "  a  b ", "a\n b\t c", " it's  we'll \r\n", "x<|endoftext|> y", "é à 漢字  z", "don't stop", "a " * 50]
    for text in odd + odd:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids and decode(ids) == plain.decode(ids, skip_special_tokens=False)


def test_tokens_travel_in_small_batches(spark):
    """A batch of texts was answered with lists of all its tokens at once."""
    from veritrim.functions import tokenizers

    held = tokenizers.token_splitter(lambda: (lambda text: [len(text)] * len(text), None)).func
    import pyarrow as pa

    made = list(held(iter([pa.array(["ab", None, "c", ""] * 200)])))
    assert [len(m) for m in made] == [256, 256, 256, 32]
    assert made[0].to_pylist()[:4] == [[2, 2], [], [1], []]


def test_the_question_travels_in_the_prompt_only(spark):
    """Cells carried the question beside the prompt, once for each model and mode."""
    from veritrim.plans.experiment import plan_cells
    from veritrim.schemas import RESULT_LOG, Settings

    samples = spark.createDataFrame([("1", "d", "", "what is it", "x")], "id string, dataset string, context string, question string, answer string")
    for enabled in (True, False):
        cells = plan_cells(samples, spark.createDataFrame([], RESULT_LOG), Settings(models=("m",), compression_enabled=enabled))
        assert "question" not in cells.columns
        assert all("what is it" in r.prompt for r in cells.collect())
