"""Boosted regression trees over the encoder's window summary and the known-ahead features.

One model for all steps: the step is a feature beside the time features of the step itself, and
what the tree sees of the look-back window is its summary per encoder column. Fitting is
`GBTRegressor`, or the same fit over small blocks of cells (`boosting`) where there are many of them:
a level of a tree is one pass that sums target moments per (node, feature, bin), so what moves
depends on bins and nodes, not on rows.
"""

from collections.abc import Sequence
from functools import reduce
from operator import or_

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.operators.boosting import Means, Splits, boost
from sitecast.operators.chunks import KEYS, chunk_window, drop_halo, with_halo
from sitecast.operators.sequences import encoder_summary
from sitecast.schema import ENCODER, HORIZON, LOOKBACK, TARGET, TIME

SUMMARY = [f"{c}_{s}" for c in ENCODER for s in ("avg", "min", "max", "last")] + [f"{TARGET}_valid"]
TREES, DEPTH, BINS, RATE, SEED = 10, 4, 64, 0.2, 7
# Cells that `GBTRegressor` may keep as objects, some 400 bytes each; more of them lie in blocks.
MAX_OBJECTS = 2_000_000


def tree_samples(
    df: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Samples with SUMMARY as columns and the coming rows as `ahead` (target and time features).

    The coming rows travel with the row that ends the look-back window, so samples and summary
    need no join.
    """
    w = chunk_window(keys)
    cell = F.struct(F.col(TARGET).alias("y"), *TIME)
    framed = with_halo(df.select(*keys, "row_idx", "n_rows", *ENCODER), after=horizon)
    ahead = F.array(*[F.lead(cell, k + 1).over(w) for k in range(horizon)])
    rows = drop_halo(framed.withColumn("ahead", ahead))
    summary = encoder_summary(rows, lookback=lookback, keys=keys, keep=["n_rows", "ahead"])
    whole = summary.filter(F.col("row_idx") < F.col("n_rows") - horizon)
    start = (F.col("row_idx") - (lookback - 1)).alias("start_idx")
    return whole.select(*keys, start, *SUMMARY, "ahead")


def tree_cells(sample: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per sample and step with `y` and the dense vector `features` (missing values as 0),
    which are in the array `inputs` too.

    The summary is checked and made an array once per sample; a step carries that one column, and
    its own features are appended. A NaN feature, or a NULL in the summary, is an error.
    """
    error = F.raise_error(F.lit("a feature of the trees is NULL or NaN"))
    bad = F.exists("seen", lambda v: v.isNull() | F.isnan(v))
    seen = sample.withColumn("seen", F.array(*SUMMARY))
    seen = seen.withColumn("seen", F.when(bad, error).otherwise(F.col("seen")))
    long = seen.select(*keys, "start_idx", "seen", F.posexplode("ahead").alias("step", "cell"))
    known = [F.coalesce(F.col(f"cell.{c}"), F.lit(0.0)) for c in TIME]
    own = F.array(F.col("step").cast("double"), *known)
    own = F.when(reduce(or_, [F.isnan(c) for c in known]), error).otherwise(own)
    wide = long.select(*keys, "start_idx", "step", F.col("cell.y").alias("y"), F.concat("seen", own).alias("inputs"))
    return wide.select("*", array_to_vector("inputs").alias("features"))


def fit_trees(
    cell: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    bins: int = BINS,
    rate: float = RATE,
    seed: int = SEED,
    max_objects: int = MAX_OBJECTS,
) -> GBTRegressionModel:
    """Squared-error boosting on the cells with a known target; all of them, no sample.

    The first tree counts in full, later ones, grown on twice what is left (the gradient), at
    `rate`. A feature with no more than `bins` values is split between any two of them. Above
    `max_objects` cells, splits that gain the same are decided by order, not by rounding.
    """
    known = cell.filter(F.col("y").isNotNull())
    total = known.count()
    if total <= max_objects:
        fit = GBTRegressor(
            featuresCol="features",
            labelCol="y",
            maxIter=trees,
            maxDepth=depth,
            maxBins=bins,
            stepSize=rate,
            minInfoGain=0.0,
            seed=seed,
        )
        return fit.fit(known.select("features", "y"))
    x = F.col("inputs") if "inputs" in cell.columns else vector_to_array("features")
    rows = known.select(x.alias("x"), F.col("y").cast("double").alias("y"))
    grown, limits = boost(rows, total, trees, depth, bins, rate, seed)
    return _model(cell.sparkSession, grown, limits, rate)


def _model(
    spark: SparkSession, grown: list[tuple[Splits, Means]], limits: list[np.ndarray], rate: float
) -> GBTRegressionModel:
    """The trees as Spark's own model."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    ml, regression = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression

    def node(splits: Splits, means: Means, i: int):
        if i not in splits:
            return ml.LeafNode(means[i], 0.0, None)
        f, last = splits[i]
        sides = node(splits, means, 2 * i), node(splits, means, 2 * i + 1)
        return ml.InternalNode(means[i], 0.0, 0.0, *sides, ml.ContinuousSplit(f, float(limits[f][last])), None)

    trees = new(regression.DecisionTreeRegressionModel, len(grown))
    weights = new(jvm.double, len(grown))
    for k, (splits, means) in enumerate(grown):
        trees[k] = regression.DecisionTreeRegressionModel(f"tree_{k}", node(splits, means, 1), len(limits))
        weights[k] = rate if k else 1.0
    return GBTRegressionModel(regression.GBTRegressionModel("boosted_trees", trees, weights, len(limits)))


def tree_forecast(cell: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """Cells with `yhat`."""
    return model.transform(cell).withColumnRenamed("prediction", "yhat").drop("features", "inputs")
