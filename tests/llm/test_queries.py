"""Queries with SQL against DuckDB, and the others' shape, on the smallest tables."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitecast.llm.oracles import ORACLES
from sitecast.llm.queries import QUERIES
from tests.conftest import DATA

TABLES = ["documents", "labels", "pages", "benchmark", "conversations"]


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = ordered(QUERIES[name](spark, DATA).toPandas()), ordered(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) > 0
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry.queries())


def test_entry_does_without_the_subpackage(monkeypatch):
    found = importlib.util.find_spec
    monkeypatch.setattr(
        importlib.util, "find_spec", lambda n, *a: None if n == "sitecast.llm" else found(n, *a)
    )
    assert not [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert not [n for n in entry.oracle_sql() if n.startswith("op")]


@pytest.mark.parametrize("name", ["op1_quality_rules", "op3_license_scan", "op10_chat_format"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoop"):
        assert word not in plan


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "sitecast")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "sitecast.llm" not in f.read(), name
