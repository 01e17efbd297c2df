import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import rows
from veritrim.operators.numbering import number_all
from veritrim.operators.prepare import (
    arithmetic_samples,
    dialogue_samples,
    multihop_samples,
    reading_samples,
    sample_defaults,
    sample_rejects,
    trivia_samples,
)
from veritrim.operators.skew import first_n_per_group, lookup_join
from veritrim.schemas import RAW_ARITHMETIC, RAW_MULTIHOP, RAW_READING, RAW_TRIVIA, SAMPLE
from veritrim.sources.readers import read_raw


def raw(spark, tmp_path, schema, items):
    path = tmp_path / "raw.jsonl"
    path.write_text("\n".join(json.dumps(i) for i in items))
    return read_raw(spark, str(path), schema)


def in_order(df):
    return [tuple(r) for r in df.orderBy(F.expr("int(regexp_substr(id, '[0-9]+'))")).collect()]


def test_arithmetic(spark, tmp_path):
    df = raw(
        spark, tmp_path, RAW_ARITHMETIC,
        [{"question": f"q{i}", "answer": a} for i, a in enumerate(["so #### 4", "no mark ", "a #### b #### 5", "x"])],
    )
    got = in_order(arithmetic_samples(df, [F.col("_order")], n=3))
    assert got == [
        ("gsm8k_1", "gsm8k", "", "q0", "4"),
        ("gsm8k_2", "gsm8k", "", "q1", "no mark"),
        ("gsm8k_3", "gsm8k", "", "q2", "5"),
    ]


def test_reading_numbers_survivors_without_gaps(spark, tmp_path):
    items = [{"context": "c", "question": f"q{i}", "answers": {"text": t}} for i, t in enumerate([["a", "b"], [], ["c"], ["d"]])]
    got = in_order(reading_samples(raw(spark, tmp_path, RAW_READING, items), [F.col("_order")], n=2))
    assert got == [("squad_1", "squad_v2", "c", "q0", "a"), ("squad_2", "squad_v2", "c", "q2", "c")]


def test_multihop(spark, tmp_path):
    items = [
        {"question": "q", "answer": "a", "context": {"title": ["T1", "T2", "T3"], "sentences": [["x.", "y."], ["z."]]}},
        {"question": "q", "answer": "a", "context": {"title": [], "sentences": []}},
    ]
    got = in_order(multihop_samples(raw(spark, tmp_path, RAW_MULTIHOP, items), [F.col("_order")]))
    assert [g[2] for g in got] == ["T1: x. y.\n\nT2: z.\n\n", ""]
    assert got[0][0] == "hotpot_1" and got[0][1] == "hotpot_qa"


def test_trivia(spark, tmp_path):
    items = [
        {"question": "q", "answer": {"value": "v"}, "entity_pages": {"wiki_context": ["first", "second"]}},
        {"question": "q", "answer": {"value": "w"}, "entity_pages": {"wiki_context": []}},
    ]
    got = in_order(trivia_samples(raw(spark, tmp_path, RAW_TRIVIA, items), [F.col("_order")]))
    assert got == [("trivia_1", "trivia_qa", "first", "q", "v"), ("trivia_2", "trivia_qa", "", "q", "w")]


def test_defaults_and_rejects(spark):
    samples = spark.createDataFrame([("1", None, None, "q", None), (None, "d", "c", "q", "a"), ("2", "d", "c", None, "a")], SAMPLE)
    assert rows(sample_defaults(samples)) == [("1", "unknown", "", "q", "")]
    assert sample_rejects(samples).count() == 2


def test_dialogue_samples_in_one_very_long_conversation(spark):
    """One conversation holds nearly all turns: its context comes by broadcast, its answers by turn number."""
    long = [(0, 0, "system", "be brief"), (0, 1, "system", "later")] + [
        (0, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2, 2002)
    ]
    other = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    turns = spark.createDataFrame(long + other, "conv_id bigint, turn bigint, role string, text string")
    got = {r.id: r for r in dialogue_samples(turns).collect()}
    assert len(got) == 1002
    assert all(r.context == "be brief" for i, r in got.items() if i.startswith("conv_0"))
    assert (got["conv_0_10"].question, got["conv_0_10"].answer) == ("t10", "t11")
    assert (got["conv_1_0"].context, got["conv_1_0"].answer, got["conv_1_1"].answer) == ("", "", "c")


def test_lookup_join_equals_a_plain_join(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x")
    )
    facts = facts.unionByName(spark.range(2).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("x")))
    lookup = spark.range(0, 2000, 7).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"))
    plain = facts.join(lookup, "k", "left").select("k", "x", "v")
    for most in (1, 10, 1000):
        assert rows(lookup_join(facts, lookup, "k", ["v"], most)) == rows(plain)


@pytest.mark.parametrize("hot", [7, 8])
def test_lookup_join_leaves_hot_rows_spread(spark, hot):
    """Without help from adaptive execution; key 7 is in the lookup table, key 8 is not."""
    facts = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(hot)).alias("k"), F.col("id").alias("x")
    )
    value = F.concat(F.lit("v"), "id", F.when(F.col("id") == 7, F.repeat(F.lit("x"), 70_000)).otherwise(""))
    lookup = spark.range(0, 40_000, 7).select(F.col("id").alias("k"), value.alias("v"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = lookup_join(facts, lookup, "k", ["v"], rows_per_task=3000)
        per_task = joined.filter(F.col("k") == hot).groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert sum(r["count"] for r in per_task) >= 36_000
        assert max(r["count"] for r in per_task) <= 20_000 and len(per_task) >= 3
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_n_per_group_with_one_dominant_group(spark):
    df = spark.range(0, 5000, 1, 8).select(
        F.when(F.col("id") % 10 == 0, "small").otherwise("big").alias("g"), (F.col("id") * 37 % 5003).alias("o")
    )
    every = {g: sorted(r.o for r in df.filter(F.col("g") == g).collect()) for g in ("big", "small")}
    for n, strands in ((20, 1), (20, 3), (20, 200), (1500, 2)):
        got = first_n_per_group(df, ["g"], [F.col("o")], n, strands)
        got = got.groupBy("g").agg(F.sort_array(F.collect_list("o")).alias("o"))
        assert {r.g: r.o for r in got.collect()} == {g: o[:n] for g, o in every.items()}


@pytest.mark.parametrize("stretch", [1, 997, 2**53 // 1000 + 1])
def test_number_all_across_blocks(spark, stretch):
    """Dense and sparse keys, negative ones too."""
    df = spark.range(-500, 500, 3).select(
        F.concat(F.lit("s"), (F.col("id") % 4 == 0).cast("int")).alias("s"), (F.col("id") * stretch).alias("id")
    )
    got = number_all(df, "s", "id", F.concat(F.col("s"), F.lit("_")), id_col="name", block=50)
    by_source = {}
    for r in got.orderBy("id").collect():
        by_source.setdefault(r.s, []).append(r.name)
    assert {s: len(n) for s, n in by_source.items()} == {r.s: r["count"] for r in df.groupBy("s").count().collect()}
    for s, names in by_source.items():
        assert names == [f"{s}_{i + 1}" for i in range(len(names))]


def test_rows_without_source_or_key_are_numbered(spark):
    rows_in = [("a", 1), ("a", None), ("a", 5), (None, 3), (None, None), (None, 9)]
    df = spark.createDataFrame(rows_in, "s string, k long")
    got = number_all(df, "s", "k", F.concat(F.coalesce("s", F.lit("none")), F.lit("_")), id_col="name", block=2).collect()
    assert sorted(r.name for r in got) == ["a_1", "a_2", "a_3", "none_1", "none_2", "none_3"]
    assert {r.name for r in got if r.k is None} == {"a_1", "none_1"}


def test_all_rows_unless_a_cap_is_named(spark):
    df = spark.range(0, 1500, 1, 7).select(F.col("id").alias("n"), F.lit("q").alias("question"), F.lit("w #### 1").alias("answer"))
    got = [r.id for r in arithmetic_samples(df, [F.col("n").desc()]).collect()]
    assert len(got) == 1500 and set(got) == {f"gsm8k_{i}" for i in range(1, 1501)}
    assert arithmetic_samples(df, [F.col("n")], n=1200).count() == 1200
