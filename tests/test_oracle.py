"""Every registered query with SQL is compared with DuckDB on the same
parquet tables (row count, column names, order-insensitive values)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

from .conftest import SF_SMALL

ORACLE = E.oracle_sql()
# the slowest model-side keys are covered at sf0.01 by tools/oracle_check.py
KEYS = sorted(ORACLE)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "risk_score" in df.columns
