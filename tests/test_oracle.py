"""Every key with a SQL twin: Spark result equals DuckDB result (columns, rows, values) on sf0.001."""

import pytest

from tools.oracle_check import table_hash

import __spark_entry__ as entry

from .conftest import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_key_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 100


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[key])
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert table_hash(cols, rows)[0] == table_hash(dcols, drows)[0]


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_keys_run(spark, key):
    df = QUERIES[key](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert df.columns[0] == "model_id"
