"""Multi-step forecasts, gap filling, the prediction cache and scheduled mixing.

All operators work on cells (sample x step) or on samples that carry the site's AR(1)
coefficients `a` and `b` as columns.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sitecast.functions.draws import uniform
from sitecast.operators.chunks import KEYS
from sitecast.operators.models import closed_ar1
from sitecast.operators.segments import gap_ordinals
from sitecast.operators.sequences import samples
from sitecast.schema import HORIZON, LOOKBACK, SITE, TARGET


def guided() -> Column:
    """Teacher-forced: every step sees the true previous value."""
    return F.col("a") + F.col("b") * F.col("prev")


def autoregressive() -> Column:
    """Every step sees the previous forecast; only the seed is a true value."""
    return closed_ar1(F.col("a"), F.col("b"), F.col("seed"), F.col("step"))


def hybrid(steps: int = 5) -> Column:
    """Guided for the first steps, then the autoregressive forecast made from step 0."""
    return F.when(F.col("step") < steps, guided()).otherwise(autoregressive())


def forecast_guided(cell: DataFrame) -> DataFrame:
    return cell.withColumn("yhat", guided())


def forecast_ar(cell: DataFrame) -> DataFrame:
    return cell.withColumn("yhat", autoregressive())


def forecast_hybrid(cell: DataFrame, steps: int = 5) -> DataFrame:
    return cell.withColumn("yhat", hybrid(steps))


def fill_gaps_reference(sample: DataFrame) -> DataFrame:
    """Gap fill by rounds: a missing output at step j overwrites the input of step j.

    The k-th gap is filled in round k and the last round of a batch fills nothing. A filled
    slot is not read by any other slot under a one-lag model, so a single pass gives what the
    rounds give. Expects `gap_count` and `rounds`.
    """
    ranked = gap_ordinals(sample)
    fills = F.col("ordinal") < F.col("rounds")
    return ranked.withColumn("filled", F.when(fills, guided()).otherwise(F.col("prev")))


def last_valid(framed: DataFrame, w: WindowSpec, reach: int, value: str = TARGET) -> DataFrame:
    """Add place and value of the newest valid row among the `reach` rows before this one."""
    known = F.when(F.col(value).isNotNull(), F.struct("row_idx", F.col(value).alias("y")))
    newest = F.last(known, ignorenulls=True).over(w.rowsBetween(-reach, -1))
    return framed.withColumn("newest", newest)


def aligned_samples(
    df: DataFrame, value: str = TARGET, keep: Sequence[str] = (), keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Samples whose coming rows know the last valid row before them."""
    return samples(
        df,
        value,
        extra=["row_idx", "newest"],
        keep=keep,
        derive=lambda framed, w: last_valid(framed, w, HORIZON, value),
        before=HORIZON,
        keys=keys,
        **kw,
    )


def fill_gaps_aligned(sample: DataFrame) -> DataFrame:
    """Gap fill as intended: a missing step is forecast from the last value before it, valid
    or already filled. The chain of fills has a closed form in the length of the gap."""
    kept = [c for c in sample.columns if c != "ahead"]
    long = sample.select(*kept, F.posexplode("ahead").alias("step", "cell"))
    first = F.col("start_idx") + LOOKBACK
    newest = F.col("cell.newest")
    inside = F.coalesce(newest["row_idx"] >= first, F.lit(False))
    since = F.when(inside, F.col("cell.row_idx") - newest["row_idx"]).otherwise(F.col("step") + 1)
    origin = F.when(inside, newest["y"]).otherwise(F.col("seed"))
    chain = closed_ar1(F.col("a"), F.col("b"), origin, since - 1)
    return long.select(
        *kept,
        "step",
        F.col("cell.y").alias("y"),
        since.cast("int").alias("gap_length"),
        F.coalesce(F.col("cell.y"), chain).alias("filled"),
    )


def cached_path(horizon: int = HORIZON) -> Column:
    """All autoregressive steps of a sample as one array."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)),
        lambda k: closed_ar1(F.col("a"), F.col("b"), F.col("seed"), k),
    )


def build_cache(sample: DataFrame, horizon: int = HORIZON, keys: Sequence[str] = KEYS) -> DataFrame:
    """Autoregressive forecasts of every sample, one row per sample with all steps inside."""
    return sample.select(*keys, "start_idx", cached_path(horizon).alias("cached"))


def join_cache(sample: DataFrame, cache: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Put the cached forecasts beside their samples; samples without any are skipped.

    Joined per sample, before the steps are unfolded. Both sides hold every sample, so neither
    is ever to be broadcast.
    """
    return sample.join(cache.hint("merge"), [*keys, "start_idx"])


def usage_rate(epoch: int, epochs: int) -> float:
    """Share of true inputs replaced by forecasts: a tenth at first, all of them at the end."""
    return min(1.0, 0.1 + 0.9 * epoch / (epochs - 1)) if epochs > 1 else 1.0


def scheduled_mix(
    cell: DataFrame, epoch: int, epochs: int, seed: str, mode: str = "reference"
) -> DataFrame:
    """Mix cached forecasts into the inputs: `mixed` replaces `prev`.

    Expects cells with `cached` (the sample's forecasts). A step with a missing truth always
    takes the forecast, any other step takes it when its draw falls under the epoch's rate.
    `reference` looks at truth and forecast of step j to set the input of step j; `aligned`
    looks at step j - 1, whose value the input of step j stands for.
    """
    rate = usage_rate(epoch, epochs)
    lag = {"reference": 0, "aligned": 1}[mode]
    keys = [c for c in ("dataset", SITE) if c in cell.columns]
    place = F.col("step") - lag
    draw = uniform(f"{seed}:{epoch}", *[F.col(k) for k in keys], F.col("start_idx"), place)
    gone = F.col("y").isNull() if lag == 0 else F.col("prev_missing")
    takes = (place >= 0) & (gone | (draw < rate))
    return cell.withColumn("taken", takes).withColumn(
        "mixed", F.when(takes, F.get("cached", place)).otherwise(F.col("prev"))
    )
