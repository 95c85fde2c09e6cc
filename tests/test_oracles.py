"""Every query with SQL against DuckDB, order-insensitive, on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from sitecast.plans.oracles import ORACLES
from sitecast.plans.queries import QUERIES
from tests.conftest import DATA

TABLES = ["events", "lineitem", "supplier"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(table):
    frame = table.to_pandas()
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = ordered(QUERIES[name](spark, DATA).toArrow())
    want = ordered(duck.execute(ORACLES[name]).to_arrow_table())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert same.all(), (c, got[c][~same].head(), want[c][~same].head())


# Boosted trees have no SQL; tests/test_models.py compares them with greedy ones.
NO_SQL = {"tree_forecast"}


def test_every_query_has_sql():
    assert set(QUERIES) - NO_SQL == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
