"""Forecast scores over long cells `y` (truth) and `yhat`; a missing truth is never scored."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.operators.chunks import KEYS, running
from sitecast.schema import STEP_MINUTES


def _truth(y: str, yhat: str) -> Column:
    return F.when(F.col(yhat).isNotNull(), F.col(y))


def _squared_error(y: str, yhat: str) -> Column:
    return F.pow(F.col(yhat) - F.col(y), F.lit(2.0))


def rmse(y: str = "y", yhat: str = "yhat") -> Column:
    """Aggregate: root of the mean squared error, NULL where nothing is valid."""
    return F.sqrt(F.avg(_squared_error(y, yhat)))


def masked_mse(y: str = "y", yhat: str = "yhat") -> Column:
    """Aggregate: mean squared error, 0 where nothing is valid."""
    return F.coalesce(F.avg(_squared_error(y, yhat)), F.lit(0.0))


def masked_rmse(y: str = "y", yhat: str = "yhat") -> Column:
    return F.sqrt(masked_mse(y, yhat))


def r2_from(n: Column, residual: Column, total: Column) -> Column:
    """R2 with its edge rules: under 2 cells undefined, constant truth 1 or 0."""
    return (
        F.when(n < 2, F.lit(None).cast("double"))
        .when(total == 0, F.when(residual == 0, 1.0).otherwise(0.0))
        .otherwise(1 - residual / F.nullif(total, F.lit(0.0)))
    )


def r2(y: str = "y", yhat: str = "yhat") -> Column:
    """Aggregate: pooled coefficient of determination over all valid cells."""
    truth = _truth(y, yhat)
    n = F.count(truth)
    return r2_from(n, F.sum(_squared_error(y, yhat)), n * F.var_pop(truth))


def scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(_truth("y", "yhat")).alias("n_valid"), rmse().alias("rmse"), r2().alias("r2")
    )


def metrics_by_step(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Scores per step ahead (1-based); a step without truth keeps its row with NULL scores."""
    by_step = scores(df.withColumn("step", F.col("step") + 1), [*keys, "step"])
    return by_step.withColumn("minutes_ahead", F.col("step") * STEP_MINUTES)


def evaluation_scores(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Per-step and overall scores in one pass over the cells.

    Cells are reduced to moments per step; the overall rows (step NULL) are put together
    from those, so the cells are neither expanded nor read twice.
    """
    truth = _truth("y", "yhat")
    moments = df.groupBy(*keys, (F.col("step") + 1).alias("step")).agg(
        F.count(truth).alias("n"),
        F.sum(_squared_error("y", "yhat")).alias("residual"),
        F.avg(truth).alias("mean"),
        F.var_pop(truth).alias("variance"),
    )
    group = Window.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("mean")).over(group) / F.nullif(
        F.sum("n").over(group), F.lit(0)
    )
    between = F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2.0))
    rolled = (
        moments.withColumn("grand", grand)
        .groupingSets([[*[F.col(k) for k in keys], F.col("step")], [F.col(k) for k in keys]], *keys, "step")
        .agg(
            F.sum("n").alias("n_valid"),
            F.sum("residual").alias("residual"),
            F.sum(F.col("n") * F.col("variance")).alias("within"),
            F.sum(between).alias("between"),
            F.grouping("step").alias("overall"),
        )
    )
    total = F.col("within") + F.when(F.col("overall") == 1, F.col("between")).otherwise(0.0)
    n = F.col("n_valid")
    return rolled.select(
        *keys,
        F.when(F.col("overall") == 1, "overall").otherwise("step").alias("scope"),
        "step",
        (F.col("step") * STEP_MINUTES).alias("minutes_ahead"),
        "n_valid",
        F.sqrt(F.col("residual") / F.nullif(n, F.lit(0))).alias("rmse"),
        r2_from(n, F.col("residual"), total).alias("r2"),
    )


def batch_rmse(df: DataFrame, keys: Sequence[str] = (), cols: Sequence[str] = ("yhat",)) -> DataFrame:
    """Root mean squared error per batch (0 where a batch has no truth), one column per forecast."""
    return df.groupBy(*keys, "batch_id").agg(*[masked_rmse("y", c).alias(c) for c in cols])


def batch_mean_rmse(df: DataFrame, keys: Sequence[str] = (), cols: Sequence[str] = ("yhat",)) -> DataFrame:
    """Plain mean of the batch errors: every batch weighs the same, however full it is."""
    return batch_rmse(df, keys, cols).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_batches"), *[F.avg(c).alias(c) for c in cols]
    )


def epoch_loss(batches: DataFrame, keys: Sequence[str] = (), loss: str = "loss") -> DataFrame:
    """Mean of batch losses. An undefined loss adds nothing but stays in the divisor;
    the strict form is undefined as soon as one batch is."""
    n = F.count(F.lit(1))
    lenient = F.sum(F.coalesce(F.col(loss), F.lit(0.0))) / n
    strict = F.when(F.count(loss) == n, F.sum(loss) / n)
    return batches.groupBy(*keys).agg(
        n.alias("n_batches"),
        F.count(loss).alias("n_defined"),
        lenient.alias("loss_lenient"),
        strict.alias("loss_strict"),
    )


def blend_weight(epoch: int) -> float:
    """Share of the continuous-segment loss, growing with the epoch up to one half."""
    return min(0.5, 0.05 * epoch)


def blended_loss(df: DataFrame, epoch: int, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Mean squared error mixed with that of the cells inside continuous valid segments.

    Needs the flag `in_segment`. 0 without truth, the plain error without segments.
    """
    alpha = blend_weight(epoch)
    grouped = df.groupBy(*keys).agg(
        F.avg(_squared_error("y", "yhat")).alias("base_loss"),
        F.avg(F.when(F.col("in_segment"), _squared_error("y", "yhat"))).alias("segment_loss"),
    )
    mixed = F.col("base_loss") * (1 - alpha) + F.col("segment_loss") * alpha
    return grouped.withColumn(
        "loss", F.coalesce(mixed, F.col("base_loss"), F.lit(0.0))
    )


def validate_modes(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Batch-mean error of the guided, hybrid and autoregressive forecasts, one row each."""
    modes = ["guided", "hybrid", "autoregressive"]
    means = batch_mean_rmse(df, keys, modes)
    return means.unpivot([*keys, "n_batches"], modes, "mode", "rmse")


def metric_stall(
    df: DataFrame, patience: int, metric: str = "rmse", idx: str = "epoch", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Best-so-far, epochs without improvement and the stop flag over a metric history.

    Only a strictly smaller value counts as an improvement; a missing metric never does. The
    running minimum of (metric, epoch) holds the best value and the first epoch that had it.
    """
    pair = F.when(F.col(metric).isNotNull(), F.struct(metric, idx))
    seen = running(df.withColumn("pair", pair), {"top": ("pair", "min")}, keys, idx, levels=2)
    since = F.col(idx) - F.col(f"top.{idx}")
    marked = seen.withColumn("out", F.when(since >= patience, 1).otherwise(0))
    ended = running(marked, {"stopped": ("out", "max")}, keys, idx, levels=2)
    return ended.select(
        *df.columns,
        F.col(f"top.{metric}").alias("best"),
        F.coalesce(since == 0, F.lit(False)).alias("improved"),
        since.alias("epochs_since_best"),
        (F.col("stopped") == 1).alias("stopped"),
    )
