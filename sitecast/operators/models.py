"""Forecast models that are fitted and applied by Spark jobs."""

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sitecast.operators.chunks import (
    KEYS,
    attach_by_chunk,
    attach_by_site,
    chunk_window,
    drop_halo,
    with_halo,
)
from sitecast.operators.sequences import samples
from sitecast.functions.values import zscore
from sitecast.schema import HORIZON, LOOKBACK, MIN_STD, SITE, TARGET, TIME, WEATHER


def with_lag(df: DataFrame, value: str = TARGET, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add `before`, the raw previous value (missing stays missing)."""
    framed = with_halo(df, before=1)
    return drop_halo(framed.withColumn("before", F.lag(value, 1).over(chunk_window(keys))))


def regression(y: Column | str, x: Column | str) -> list[Column]:
    """Aggregates `a`, `b` of y = a + b x over pairs without missing values.

    Without a usable slope the model falls back to the mean level.
    """
    y, x = (F.col(c) if isinstance(c, str) else c for c in (y, x))
    slope = F.regr_slope(y, x)
    level = F.coalesce(F.regr_intercept(y, x), F.avg(y), F.lit(0.0))
    return [level.alias("a"), F.coalesce(slope, F.lit(0.0)).alias("b"), F.regr_count(y, x).alias("n_pairs")]


def fit_ar1(df: DataFrame, value: str = TARGET, train: Column | None = None) -> DataFrame:
    """y_t = a + b y_(t-1) per site over the valid pairs of the training rows."""
    pairs = with_lag(df.select(SITE, "row_idx", "n_rows", value), value)
    if train is not None:
        pairs = pairs.filter(train)
    return pairs.groupBy(SITE).agg(*regression(value, "before"))


def fit_scaled_ar1(df: DataFrame, value: str = TARGET, train: Column | None = None) -> DataFrame:
    """Statistics and AR(1) of the scaled series from the raw one, in a single pass.

    Scaling moves and stretches both sides of the regression alike: the slope stays and the
    intercept follows from the mean and spread. Adds `{value}_mean`, `{value}_std` and `n_rows`.
    """
    pairs = with_lag(df.select(SITE, "row_idx", "n_rows", value), value)
    if train is not None:
        pairs = pairs.filter(train)
    mean, std = f"{value}_mean", f"{value}_std"
    fitted = pairs.groupBy(SITE).agg(
        F.max("n_rows").alias("n_rows"),
        F.avg(value).alias(mean), F.stddev_samp(value).alias(std), *regression(value, "before")
    )
    scaled = F.col(std) > MIN_STD
    moved = (F.col("a") + (F.col("b") - 1) * F.col(mean)) / F.col(std)
    # Without a single valid value there is no level to start from.
    moved = F.coalesce(moved, F.lit(0.0))
    return fitted.withColumn("a", F.when(scaled, moved).otherwise(F.col("a")))


def attach_model(df: DataFrame, site_model: DataFrame, value: str = TARGET) -> DataFrame:
    """Scale the target and put the site's `a`, `b`, mean and spread beside every row."""
    joined = attach_by_chunk(df, site_model.select(SITE, "n_rows", *model_columns(value)))
    scaled = zscore(F.col(value), F.col(f"{value}_mean"), F.col(f"{value}_std"))
    return joined.withColumn(value, scaled)


def model_columns(value: str = TARGET) -> list[str]:
    return ["a", "b", f"{value}_mean", f"{value}_std"]


def fit_direct(cell: DataFrame) -> DataFrame:
    """One model per site and step: the value `step` rows ahead from the seed alone.

    All steps are fitted by one aggregate; there is no loop over steps.
    """
    return cell.groupBy(SITE, "step").agg(*regression("y", "seed"))


def direct_forecast(cell: DataFrame, model: DataFrame) -> DataFrame:
    """Apply the per-step models; they travel as one row per site to keep the lookup small."""
    packed = model.groupBy(SITE).agg(
        F.map_from_entries(
            F.collect_list(F.struct("step", F.struct("a", "b").alias("line")))
        ).alias("lines")
    )
    joined = attach_by_site(cell, packed)
    line = F.col("lines")[F.col("step")]
    return joined.withColumn("yhat", line["a"] + line["b"] * F.col("seed")).drop("lines")


# What the pooled linear model sees of a step: the previous target and the time features of
# the step itself; and of the look-back window that ends at the seed the mean of every weather
# feature and of the target, and the share of valid targets.
STEP_FEATURES = ["prev", *TIME]
WINDOW_FEATURES = [*[f"{c}_level" for c in WEATHER], "window_avg", "window_share"]


def look_back_features(framed: DataFrame, w: WindowSpec, lookback: int, ends: int, value: str) -> DataFrame:
    """WINDOW_FEATURES of the `lookback` rows that end `-ends` rows back.

    Differences of running sums within the chunk, so a row costs the same for any look-back.
    """
    sums = {f"{c}_level": F.coalesce(F.col(c), F.lit(0.0)) for c in WEATHER}
    sums["window_avg"] = F.coalesce(F.col(value), F.lit(0.0))
    sums["window_share"] = F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    added = framed.withColumns({f"{n}_sum": F.sum(c).over(upto) for n, c in sums.items()})

    def at(name: str, back: int) -> Column:
        total = F.col(f"{name}_sum")
        return F.coalesce(F.lag(total, back).over(w) if back else total, F.lit(0.0))

    out = {n: (at(n, -ends) - at(n, lookback - ends)) / lookback for n in sums}
    return added.withColumns(out).drop(*[f"{n}_sum" for n in sums])


def arx_rows(
    df: DataFrame, lookback: int = LOOKBACK, value: str = TARGET, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Training rows of the pooled model; the look-back window ends one row earlier."""
    w = chunk_window(keys)
    lean = df.select(*keys, "row_idx", "n_rows", *WEATHER, *TIME, value)
    framed = look_back_features(with_halo(lean, before=lookback), w, lookback, -1, value)
    framed = framed.withColumn("prev", F.coalesce(F.lag(value, 1).over(w), F.lit(0.0)))
    return drop_halo(framed).filter(F.col("row_idx") >= lookback)


def fit_arx(rows: DataFrame, value: str = TARGET) -> LinearRegressionModel:
    """Pooled one-step least squares by the normal equations (one distributed pass)."""
    assembler = VectorAssembler(inputCols=STEP_FEATURES + WINDOW_FEATURES, outputCol="features")
    usable = rows.filter(F.col(value).isNotNull()).dropna(subset=STEP_FEATURES + WINDOW_FEATURES)
    fit = LinearRegression(featuresCol="features", labelCol=value, solver="normal")
    return fit.fit(assembler.transform(usable).select("features", value))


def arx_weights(model: LinearRegressionModel) -> dict[str, float]:
    names = STEP_FEATURES + WINDOW_FEATURES
    return {"intercept": float(model.intercept), **dict(zip(names, map(float, model.coefficients)))}


def arx_forecast(
    df: DataFrame,
    weights: dict[str, float],
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    value: str = TARGET,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Autoregressive roll-out of the pooled model: cells with `y` and `yhat`.

    With a linear model a step adds what the look-back window gives and what the known features
    of the step give to a part of the step before; a sample is folded once for all its steps.
    """
    b = weights["prev"]
    known = sum((F.col(c) * weights[c] for c in TIME), F.lit(0.0))
    sample = samples(
        df.select(*keys, "row_idx", "n_rows", *WEATHER, value, known.alias("known")),
        value,
        extra=["known"],
        keep=WINDOW_FEATURES,
        derive=lambda framed, w: look_back_features(framed, w, lookback, 0, value),
        before=lookback - 1,
        lookback=lookback,
        horizon=horizon,
        keys=keys,
    )
    level = sum((F.col(c) * weights[c] for c in WINDOW_FEATURES), F.lit(weights["intercept"]))
    folded = F.aggregate(
        "ahead",
        F.array("seed"),
        lambda path, c: F.concat(path, F.array(F.element_at(path, -1) * b + F.col("level") + c["known"])),
    )
    path = sample.select(*keys, "start_idx", "seed", "ahead", level.alias("level"))
    path = path.select(*keys, "start_idx", F.col("ahead.y").alias("y"), folded.alias("path"))
    long = path.select(*keys, "start_idx", "path", F.posexplode("y").alias("step", "y"))
    return long.select(
        *keys, "start_idx", "step", "y", F.get("path", F.col("step") + 1).alias("yhat")
    )


def closed_ar1(a: Column, b: Column, seed: Column, step: Column | int) -> Column:
    """Value of the AR(1) roll-out `step` (0-based) without rolling."""
    n = (F.lit(step) if isinstance(step, int) else step) + 1
    power = F.pow(b, n.cast("double"))
    drift = F.when(F.abs(1 - b) < 1e-9, a * n).otherwise(
        a * (1 - power) / F.nullif(1 - b, F.lit(0.0))
    )
    return power * seed + drift
