"""Every registered query against its SQL on the smallest data folder."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert check.compare(got, duck.execute(ORACLES[name]).fetch_df()).startswith("ok")


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_oracles_have_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 < row["p"] <= 1 and 0 < row["r"] <= 1 and 0 < row["coverage"] <= 1
