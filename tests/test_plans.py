"""What the physical plans must and must not hold."""

import pytest
from pyspark.sql import functions as F

from sitecast.operators import forecast as FC
from sitecast.operators import sequences as SQ
from sitecast.plans.queries import QUERIES
from sitecast.sources.buckets import forget, read_bucketed, write_bucketed
from tests.conftest import DATA

LAZY = sorted(QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, DATA))
    for word in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_flagship_prunes_the_scan(spark):
    plan = plan_of(QUERIES["evaluation_report"](spark, DATA))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in plan
    assert "props" not in plan


def test_flagship_scans_the_values_once(spark):
    df = QUERIES["evaluation_report"](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_readings_are_never_the_broadcast_side(spark):
    """Even where Spark takes everything for small, only the right side may be broadcast."""
    plan = plan_of(QUERIES["power_rescaled"](spark, DATA))
    assert "BuildLeft" not in plan


def test_top_picks_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(QUERIES["forecast_samples"](spark, DATA))
    assert "WindowGroupLimit" in plan_of(QUERIES["champion_sites"](spark, DATA))


LIMITS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


@pytest.fixture
def no_broadcast(spark):
    for limit in LIMITS:
        spark.conf.set(limit, "-1")
    yield
    for limit in LIMITS:
        spark.conf.unset(limit)


def test_cache_and_samples_join_where_they_lie(spark, series, no_broadcast, tmp_path):
    known = SQ.samples(series).withColumns({"a": F.lit(0.5), "b": F.lit(0.2)})
    keys, here = ["campus_key", "start_idx"], str(tmp_path / "sample")
    write_bucketed(known.repartition(8, *keys), here, keys, 8)
    sample = read_bucketed(spark, here, keys, 8)
    write_bucketed(FC.build_cache(sample), str(tmp_path / "cache"), keys, 8)
    joined = FC.join_cache(sample, read_bucketed(spark, str(tmp_path / "cache"), keys, 8))
    plan = plan_of(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert joined.count() == known.count()
    moved = FC.join_cache(known, FC.build_cache(known))
    assert sorted(r["cached"] for r in joined.collect()) == sorted(r["cached"] for r in moved.collect())
    before = {t.name for t in spark.catalog.listTables()}
    forget(sample)
    assert len(before - {t.name for t in spark.catalog.listTables()}) == 1


def test_models_are_looked_up_by_chunk(spark, no_broadcast):
    """With broadcasts off, no reading is moved by its site alone once the grid is built."""
    plan = plan_of(QUERIES["evaluation_report"](spark, DATA))
    assert "site_text" not in plan
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("chunk_id" in line for line in joins)
