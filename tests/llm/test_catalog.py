"""The registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tools.compare import duck, rows
from veritrim.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql()) and "pipeline" in queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duck(SF)
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())
    con.close()


def test_pipeline(spark):
    from tests.llm.test_decontaminate import brute as leaks
    from tests.llm.test_jaccard_join import brute as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, items = docs.collect(), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        after = out.collect()
        pairs = [(r.doc_id, r.text) for r in before]
        if name == "language_id":
            assert len(after) == sum(any(c.isalpha() for c in r.text or "") for r in before)
        elif name == "near_duplicates":
            assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in groups(pairs)})
        elif name == "decontamination":
            assert sorted(r.doc_id for r in after) == sorted(d for d, _, _, _, hit in leaks(pairs, items, 10) if not hit)
        elif name == "mixing":
            words = lambda rs: sum(len(r.text.split()) for r in rs)
            assert words(after) == pytest.approx(1.5 * words(before), rel=0.1)
        else:
            assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
            break
        assert out.columns == docs.columns
        docs, before = spark.createDataFrame(after, docs.schema), after
