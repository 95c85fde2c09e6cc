"""States per day, merged, against a fit on all readings at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitecast.operators import models as MD
from sitecast.operators import moments as MO
from sitecast.operators import scaling as SC
from sitecast.schema import TARGET
from sitecast.sources import states as S
from sitecast.sources import versions

OTHER = "AirTemperature"
COLS = [TARGET, OTHER]


@pytest.fixture(scope="module")
def slotted(spark):
    """Sites with gaps, a flat site about a large mean, one with a single value, one without."""
    rng = np.random.default_rng(6)
    rows = []
    for slot in range(100, 100 + 96 * 6):
        if rng.random() < 0.8:
            y = None if rng.random() < 0.2 else float(rng.normal(3, 2))
            rows.append((1, slot, y, float(rng.normal())))
        rows.append((2, slot, 1e6 + 1e-3 * (slot % 5), 4.0))
    rows += [(3, 195, 5.0, None), (4, 200, None, None), (None, 200, 1.0, 1.0), (5, 191, 1.0, 0.0), (5, 192, 2.0, 0.0), (5, 193, 4.0, 1.0)]
    return spark.createDataFrame(rows, f"campus_key int, slot bigint, {TARGET} double, {OTHER} double").cache()


def whole(slotted):
    """Statistics and AR(1) from the rows themselves."""
    known = slotted.filter("campus_key IS NOT NULL")
    stats = SC.fit_stats(known, COLS)
    pairs = known.alias("t").join(known.alias("b"), F.expr("t.campus_key = b.campus_key AND t.slot = b.slot + 1"), "left")
    fitted = pairs.select(F.col("t.campus_key").alias("campus_key"), F.col(f"t.{TARGET}").alias("y"), F.col(f"b.{TARGET}").alias("x"))
    model = fitted.groupBy("campus_key").agg(*MD.regression("y", "x"))
    return {r["campus_key"]: r.asDict() for r in stats.join(model, "campus_key").collect()}


def same(got, want):
    assert set(got) == set(want)
    for site, w in want.items():
        for name, value in w.items():
            assert got[site][name] == (None if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), (site, name)


def fitted(states):
    return {r["campus_key"]: r.asDict() for r in MO.fit_from_states(states, COLS).collect()}


def test_states_merge_to_the_whole_fit(slotted):
    got = fitted(MO.day_states(slotted, COLS))
    same(got, whole(slotted))
    assert got[2][f"{TARGET}_std"] == pytest.approx(1e-3 * np.std(np.arange(576) % 5, ddof=1), rel=1e-4)
    assert got[3][f"{TARGET}_std"] is None and got[4][f"{TARGET}_n"] == 0 and got[5]["n_pairs"] == 2


def test_new_days_update_the_store(spark, slotted, tmp_path):
    """History, then a new day in three calls: parts, a failed one, and the whole day again."""
    root = str(tmp_path / "states")
    day = MO.day_of(F.col("slot"))
    history, last = slotted.filter(day < 5), slotted.filter(day >= 5)
    S.add_days(MO.day_states(history, COLS), root)
    S.add_days(MO.day_states(last.filter("slot < 530"), COLS), root)
    same(fitted(S.read_states(spark, root)), whole(history.union(last.filter("slot < 530"))))
    broken = MO.day_states(last, COLS).withColumn("opens", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception):
        S.add_days(broken, root)
    S.add_days(MO.day_states(last, COLS), root)
    assert len(versions.earlier(spark, root)) == 3
    same(fitted(S.read_states(spark, root)), whole(slotted))
    S.compact(spark, root)
    assert len(versions.earlier(spark, root)) == 1
    same(fitted(S.read_states(spark, root)), whole(slotted))


def test_batches_become_one(spark, slotted, tmp_path):
    root = str(tmp_path / "states")
    for d in range(1, 8):
        S.add_days(MO.day_states(slotted.filter(MO.day_of(F.col("slot")) == d), COLS), root, max_batches=3)
        assert len(versions.earlier(spark, root)) <= 3
    same(fitted(S.read_states(spark, root)), whole(slotted))
    with pytest.raises(FileNotFoundError):
        S.read_states(spark, str(tmp_path / "none"))


def test_scaled_model_is_that_of_the_one_pass_fit(series):
    slotted = series.withColumn("slot", F.col("row_idx"))
    got = MO.scaled_model(MO.fit_from_states(MO.day_states(slotted, [TARGET]), [TARGET]))
    want = {r["campus_key"]: r for r in MD.fit_scaled_ar1(series).collect()}
    for r in got.collect():
        for name in ("a", "b", f"{TARGET}_mean", f"{TARGET}_std", "n_pairs"):
            assert r[name] == pytest.approx(want[r["campus_key"]][name], rel=1e-9, abs=1e-9)
