"""Every registered graph query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].itertuples(index=False))


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    assert normal(queries.QUERIES[name](spark, SF).toPandas()) == normal(duck.execute(queries.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).columns == ["o", "c", "s", "n"]
