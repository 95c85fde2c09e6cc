"""Joint linear forecast: all steps of the horizon at once from what the seed row knows.

The inputs of a sample are the same for every step, so one pass over the samples sums what the
least squares of all steps need: per step the products of inputs and target over the samples
whose target at that step is known. The driver gets one row of sums per step and solves small
systems; nothing on it grows with the data.
"""

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.operators.chunks import KEYS
from sitecast.operators.models import WINDOW_FEATURES, look_back_features
from sitecast.operators.sequences import samples
from sitecast.schema import HORIZON, LOOKBACK, TARGET, TIME, WEATHER

INPUTS = ("seed", *WINDOW_FEATURES, *TIME)


def joint_samples(
    df: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    value: str = TARGET,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Samples with INPUTS as columns and the coming targets as the array `y`.

    Samples with a missing input (a time feature; all others are filled) are left out.
    """
    sample = samples(
        df.select(*keys, "row_idx", "n_rows", *WEATHER, *TIME, value),
        value,
        keep=[*WINDOW_FEATURES, *TIME],
        derive=lambda framed, w: look_back_features(framed, w, lookback, 0, value),
        before=lookback - 1,
        lookback=lookback,
        horizon=horizon,
        keys=keys,
    )
    return sample.select(*keys, "start_idx", *INPUTS, F.col("ahead.y").alias("y")).dropna(subset=list(INPUTS))


def joint_moments(sample: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    """Per step: `n` and the sums of inputs, target and all their products (one row each)."""
    long = sample.select(*inputs, F.posexplode("y").alias("step", "target"))
    long = long.filter(F.col("target").isNotNull())
    columns = [*inputs, "target"]
    sums = [F.sum(c).alias(f"s_{i}") for i, c in enumerate(columns)]
    sums += [
        F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
        if i <= j
    ]
    return long.groupBy("step").agg(F.count(F.lit(1)).alias("n"), *sums)


def solve_joint(moments: list, horizon: int = HORIZON, inputs: Sequence[str] = INPUTS) -> list[dict[str, float]]:
    """Weights per step (with `intercept`) from the rows of `joint_moments`.

    Inputs that the others determine get the least weights that fit as well. A step without any
    target has no weights (an empty dict).
    """
    out: list[dict[str, float]] = [{} for _ in range(horizon)]
    k = len(inputs)
    for row in moments:
        n = row["n"]
        mean = np.array([row[f"s_{i}"] for i in range(k + 1)]) / n
        product = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                product[i, j] = product[j, i] = row[f"p_{i}_{j}"] / n
        spread = product - np.outer(mean, mean)
        # To unit spread first, so that what counts as determined does not hang on units.
        size = np.sqrt(np.maximum(np.diag(spread)[:k], 0.0))
        size[size < 1e-9 * (1 + np.abs(mean[:k]))] = np.inf
        gram = spread[:k, :k] / np.outer(size, size)
        weights = np.linalg.pinv(gram, rcond=1e-10, hermitian=True) @ (spread[:k, k] / size) / size
        out[row["step"]] = {"intercept": float(mean[k] - weights @ mean[:k]), **dict(zip(inputs, map(float, weights)))}
    return out


def fit_joint(sample: DataFrame, horizon: int = HORIZON, inputs: Sequence[str] = INPUTS) -> list[dict[str, float]]:
    """Least squares of every step from one pass over the samples."""
    return solve_joint(joint_moments(sample, inputs).collect(), horizon, inputs)


def joint_forecast(sample: DataFrame, weights: list[dict[str, float]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Cells with `y` and `yhat`; a step without weights has no forecast."""

    def line(of: dict[str, float]):
        if not of:
            return F.lit(None).cast("double")
        parts = (F.col(c) * w for c, w in of.items() if c != "intercept")
        return sum(parts, F.lit(of["intercept"]))

    path = F.array(*[line(w) for w in weights]).alias("path")
    long = sample.select(*keys, "start_idx", path, F.posexplode("y").alias("step", "y"))
    return long.select(*keys, "start_idx", "step", "y", F.get("path", F.col("step")).alias("yhat"))
