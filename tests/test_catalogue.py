"""Every registered query beside its oracle, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import compare
from cohortry.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in compare.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()) == ""


def test_contract(spark):
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 12
