"""The joint and the tree forecast against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from sitecast.operators import boosting as B
from sitecast.operators import joint as J
from sitecast.operators import trees as TR
from sitecast.schema import ENCODER, TARGET, TIME, WEATHER


@pytest.fixture(scope="module")
def full(spark, series):
    """The common series with weather and time columns that depend on site and row."""
    other = {c: F.sin(F.col("row_idx") * (0.11 + 0.07 * i) + F.col("campus_key")) for i, c in enumerate([*WEATHER, *TIME])}
    holes = {WEATHER[0]: F.when(F.col("row_idx") % 5 != 2, other[WEATHER[0]])}
    return series.withColumns(other | holes).cache()


@pytest.fixture(scope="module")
def by_site(full):
    out = {}
    for r in sorted(full.collect(), key=lambda r: (r["campus_key"], r["row_idx"])):
        out.setdefault(r["campus_key"], []).append(r)
    return out


def windows(by_site):
    """(site, start, look-back rows, horizon rows) of every sample."""
    for site, rows in by_site.items():
        for start in range(len(rows) - 115):
            yield site, start, rows[start : start + 96], rows[start + 96 : start + 116]


def filled(rows, c):
    return [0.0 if r[c] is None else r[c] for r in rows]


def inputs(back):
    level = [np.mean(filled(back, c)) for c in WEATHER]
    target = filled(back, TARGET)
    share = np.mean([r[TARGET] is not None for r in back])
    return [target[-1], *level, np.mean(target), share, *[back[-1][c] for c in TIME]]


def test_joint_weights_are_least_squares_of_each_step(full, by_site):
    sample = J.joint_samples(full)
    got = J.fit_joint(sample)
    x = np.array([inputs(back) for _, _, back, _ in windows(by_site)])
    for step in range(20):
        y = np.array([np.nan if (v := ahead[step][TARGET]) is None else v for _, _, _, ahead in windows(by_site)])
        known = ~np.isnan(y)
        design = np.column_stack([np.ones(known.sum()), x[known]])
        want = np.linalg.lstsq(design, y[known], rcond=None)[0]
        mine = np.array([got[step][c] for c in ("intercept", *J.INPUTS)])
        assert design @ mine == pytest.approx(design @ want, abs=1e-6)
    cell = J.joint_forecast(sample, got).collect()
    assert len(cell) == 20 * len(x)
    at = {(r["campus_key"], r["start_idx"], r["step"]): r for r in cell}
    for (site, start, back, ahead), row in zip(windows(by_site), x):
        for step in (0, 7, 19):
            r = at[site, start, step]
            assert r["y"] == ahead[step][TARGET]
            want = got[step]["intercept"] + sum(got[step][c] * v for c, v in zip(J.INPUTS, row))
            assert r["yhat"] == pytest.approx(want, abs=1e-9)


def test_joint_steps_without_truth_and_inputs_that_repeat(spark):
    """A step without any target has no forecast; a constant input and a copied one do no harm."""
    rng = np.random.default_rng(1)
    rows = [(1, i, float(a), 2 * float(a) + 1, 5.0, [3 * float(a) - 2, None]) for i, a in enumerate(rng.normal(size=50))]
    sample = spark.createDataFrame(rows, "campus_key int, start_idx int, a double, b double, c double, y array<double>")
    got = J.fit_joint(sample, 2, ["a", "b", "c"])
    assert got[1] == {} and len(got) == 2
    assert got[0]["a"] + 2 * got[0]["b"] == pytest.approx(3) and got[0]["c"] == 0
    out = {(r["start_idx"], r["step"]): r["yhat"] for r in J.joint_forecast(sample, got).collect()}
    assert out[3, 0] == pytest.approx(rows[3][5][0]) and out[3, 1] is None
    assert J.fit_joint(sample.limit(0), 2, ["a", "b", "c"]) == [{}, {}]


def test_joint_moments_are_one_aggregate(full):
    plan = J.joint_moments(J.joint_samples(full))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "InArrow" not in plan


def test_tree_features_against_a_loop(full, by_site):
    cell = TR.tree_cells(TR.tree_samples(full))
    at = {(r["campus_key"], r["start_idx"], r["step"]): r for r in cell.collect()}
    many = list(windows(by_site))
    assert len(at) == 20 * len(many)
    for site, start, back, ahead in many[::7]:
        summary = [f(filled(back, c)) for c in ENCODER for f in (np.mean, min, max, lambda v: v[-1])]
        summary.append(sum(r[TARGET] is not None for r in back))
        for step in (0, 19):
            r = at[site, start, step]
            assert r["y"] == ahead[step][TARGET]
            want = [*summary, step, *[ahead[step][c] for c in TIME]]
            assert r["features"].toArray() == pytest.approx(want, abs=1e-9)


def few_samples(spark, first, zenith=0.0):
    """Two samples of two steps; all other summary values and time features are 0."""
    ahead = [(1.5, zenith, *[0.0] * (len(TIME) - 1)), (None, *[None] * len(TIME))]
    rows = [(site, 0, first, *[0.0] * (len(TR.SUMMARY) - 1), ahead) for site in (1, 2)]
    step = ", ".join(f"{c}: double" for c in ["y", *TIME])
    names = ", ".join(f"{c} double" for c in TR.SUMMARY)
    return spark.createDataFrame(rows, f"campus_key int, start_idx long, {names}, ahead array<struct<{step}>>")


def test_tree_cells_carry_one_summary_column(spark):
    """A step copies the summary as one column, not 41, and its vector stays dense."""
    cell = TR.tree_cells(few_samples(spark, 2.0))
    plan = cell._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("posexplode")]
    assert "seen" in above and TR.SUMMARY[0] not in above
    for r in cell.collect():
        assert type(r["features"]).__name__ == "DenseVector"
        want = [2.0, *[0.0] * (len(TR.SUMMARY) - 1), r["step"], *[0.0] * len(TIME)]
        assert r["features"].toArray().tolist() == want
        assert r["y"] == (1.5 if r["step"] == 0 else None)


@pytest.mark.parametrize("first, zenith", [(None, 0.0), (float("nan"), 0.0), (2.0, float("nan"))])
def test_tree_cells_refuse_a_feature_without_a_number(spark, first, zenith):
    with pytest.raises(Exception, match="NULL or NaN"):
        TR.tree_cells(few_samples(spark, first, zenith)).collect()


def grown(x, y, depth):
    """Predictions of a greedy least-squares tree, splits between any two values."""
    best = (1e-12, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for low, high in zip(values, values[1:]):
                left = x[:, f] <= (low + high) / 2
                gain = ((y - y.mean()) ** 2).sum() - sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left))
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if best[1] is None:
        return np.full(len(y), y.mean())
    out = np.empty(len(y))
    for side in (best[1], ~best[1]):
        out[side] = grown(x[side], y[side], depth - 1)
    return out


@pytest.mark.parametrize("trees", [1, 4])
def test_trees_equal_greedy_ones(spark, trees):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, size=(400, 4)).astype(float)
    y = np.where(x[:, 0] > 4, 3.0, -1.0) * x[:, 1] + x[:, 2] ** 2 / 5 + rng.normal(size=400)
    rows = [(int(i), float(t), Vectors.dense(v)) for i, (v, t) in enumerate(zip(x, y))]
    rows.append((400, None, Vectors.dense([1.0, 2.0, 3.0, 4.0])))
    cell = spark.createDataFrame(rows, ["i", "y", "features"])
    model = TR.fit_trees(cell, trees=trees, depth=3, rate=0.5)
    got = {r["i"]: r["yhat"] for r in TR.tree_forecast(cell, model).collect()}
    assert got[400] is not None
    # The first tree counts in full; each later one is grown on the squared error's gradient,
    # which is twice what is left, and counts at the rate.
    want = grown(x, y, 3)
    for _ in range(trees - 1):
        want = want + 0.5 * grown(x, 2 * (y - want), 3)
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-6)


def test_trees_learn_what_a_line_cannot(full):
    """Fitted on some samples, better on others than their mean."""
    bent = full.withColumn(TARGET, F.when(F.col(TARGET).isNotNull(), F.abs(F.col(TIME[0])) * 10))
    cell = TR.tree_cells(TR.tree_samples(bent)).cache()
    model = TR.fit_trees(cell.filter("start_idx < 120"))
    held = TR.tree_forecast(cell.filter("start_idx >= 140 and y is not null"), model)
    r = held.agg(F.avg(F.pow(F.col("y") - F.col("yhat"), 2.0)).alias("e"), F.var_pop("y").alias("v")).first()
    assert r["e"] < 0.2 * r["v"]


def wavy(spark, n, parts):
    """Rows in runs of seven: features of the run, of the row, constant, and with zeros."""
    run, row = F.expr("id div 7"), F.col("id")
    x = [F.sin(run * 1.7), F.when(run % 3 == 0, 0.0).otherwise(F.cos(run * 0.37)), F.lit(2.0)]
    x += [(row % 7).cast("double"), F.when(F.sin(row * 5.1) > 0, 0.0).otherwise(F.cos(row * 1.3))]
    y = F.expr("inputs[0] * inputs[3] + case when inputs[1] > 0.3 then 4 else inputs[4] end + sin(id * 12.9)")
    rows = spark.range(n, numPartitions=parts).select("id", F.array(*x).alias("inputs"))
    rows = rows.withColumn("y", F.when(row % 5 != 1, y))
    return rows.select("*", array_to_vector("inputs").alias("features"))


@pytest.mark.parametrize("n, bins, depth", [(300, 64, 4), (30_000, 64, 4), (20_000, 300, 3), (300, 8, 0)])
def test_trees_are_those_of_spark(spark, n, bins, depth):
    """Bins of all rows or of a sample, bins of one byte or two."""
    cell = wavy(spark, n, 3)
    known = cell.filter("y is not null").select("features", "y")
    spark_fit = GBTRegressor(labelCol="y", maxIter=4, maxDepth=depth, maxBins=bins, stepSize=0.2, seed=7).fit(known)
    model = TR.fit_trees(cell, 4, depth, bins, 0.2, 7, max_objects=0)
    both = spark_fit.transform(TR.tree_forecast(cell, model).join(cell.select("id", "features"), "id"))
    assert both.filter(F.abs(F.col("yhat") - F.col("prediction")) > 1e-9).count() == 0
    assert both.count() == n and len(model.trees) == 4 and model.treeWeights == spark_fit.treeWeights


def test_blocks_hold_a_summary_once_per_sample(spark, full):
    """Not once per step, as rows of all their bins do (46 integers for each)."""
    cell = TR.tree_cells(TR.tree_samples(full)).filter("y is not null")
    rows = cell.select(F.col("inputs").alias("x"), "y")
    limits = B._limits(rows, rows.count(), 64, 7)
    blocks = rows.mapInArrow(B._packer(limits), B.BLOCK).collect()
    cells = sum(len(b["y"]) // 8 for b in blocks)
    held = sum(len(b[c]) for b in blocks for c in ("runs", "slow_bins", "fast_bins", "y", "p"))
    assert cells == rows.count() and held < 40 * cells
    assert all(len(b["slow"]) >= len(TR.SUMMARY) for b in blocks)


@pytest.mark.parametrize("parts", [1, 4])
def test_the_first_of_equal_splits_is_taken(spark, parts):
    rows = [(int(i), float(v), Vectors.dense([w, -v, v])) for i, (v, w) in enumerate(np.random.default_rng(2).normal(size=(500, 2)))]
    cell = spark.createDataFrame(rows, ["i", "y", "features"]).repartition(parts, "i")
    root = TR.fit_trees(cell, trees=1, depth=1, max_objects=0).trees[0].toDebugString
    assert "feature 1 " in root and "feature 2 " not in root


@pytest.mark.parametrize("y, feature", [(float("nan"), 1.0), (float("inf"), 1.0), (1.0, float("inf"))])
def test_trees_refuse_what_is_no_number(spark, y, feature):
    cell = spark.createDataFrame([(1.0, Vectors.dense([1.0])), (y, Vectors.dense([feature]))], ["y", "features"])
    with pytest.raises(Exception, match="NULL, NaN or infinite"):
        TR.fit_trees(cell, max_objects=0)
    with pytest.raises(ValueError, match="no rows"):
        TR.fit_trees(cell.filter("y is null"), max_objects=-1)


def test_many_cells_are_fitted_in_blocks(spark, monkeypatch):
    """Only up to the limit does `GBTRegressor` keep them as objects."""
    fitted = []
    monkeypatch.setattr(TR, "GBTRegressor", lambda **of: fitted.append(of) or GBTRegressor(**of))
    cell = wavy(spark, 300, 2)
    n = cell.filter("y is not null").count()
    TR.fit_trees(cell, trees=1, depth=1, max_objects=n)
    assert len(fitted) == 1
    TR.fit_trees(cell, trees=1, depth=1, max_objects=n - 1)
    assert len(fitted) == 1
