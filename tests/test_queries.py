"""Every registered query against its SQL in DuckDB, whole results."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.compare import TABLES, duck, rows
from veritrim.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duck(SF)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert len(TABLES) == 14 and isinstance(duckdb.__version__, str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    result = con.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, result.fetchall())


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["model_name", "dataset"]
