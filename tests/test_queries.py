"""Queries against their SQL in DuckDB, over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from larder.plans.registry import QUERIES, SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


def rows(values):
    return sorted((tuple("" if v is None or v != v else str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row) for row in values))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = tables.sql(SQL[name])
    assert sorted(wanted.columns) == columns
    wanted = tables.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert rows(tuple(r) for r in found.select(columns).collect()) == rows(wanted)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
