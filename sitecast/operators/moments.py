"""Statistics and AR(1) of a site from stored, mergeable states, one per (site, day).

A state holds count, mean and squared deviation of every column, the same for the pairs of
neighbouring slots inside the day, and the target at the day's first and last slot, from which
the pair across midnight is made when the next day is there. New days need only their own
readings; a fit reads states, a day's worth of readings each.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.operators.chunks import attach_by_site
from sitecast.schema import MIN_STD, SCALED, SITE, SLOTS_PER_DAY, TARGET

PAIR = ["pair_n", "pair_x", "pair_y", "pair_xx", "pair_xy"]


def day_of(slot: Column) -> Column:
    return F.floor(slot / SLOTS_PER_DAY).cast("bigint")


def day_states(
    slotted: DataFrame, cols: Sequence[str] = SCALED, value: str = TARGET, per_day: int = SLOTS_PER_DAY
) -> DataFrame:
    """States of the days that `slotted` holds (one row per site and slot, with raw `cols`).

    Slots that are missing and slots without a value are the same. Rows without a site drop out.
    """
    day = F.floor(F.col("slot") / per_day).cast("bigint")
    rows = slotted.filter(F.col(SITE).isNotNull()).select(SITE, "slot", day.alias("day"), *dict.fromkeys([*cols, value]))
    w = Window.partitionBy(SITE, "day").orderBy("slot")
    before = F.when(F.lag("slot").over(w) == F.col("slot") - 1, F.lag(value).over(w))
    rows = rows.withColumn("before", before)
    aggs = []
    for c in cols:
        n = F.count(c)
        aggs += [n.alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * n).alias(f"{c}_m2")]
    place = F.col("slot") - F.col("day") * per_day
    return rows.groupBy(SITE, "day").agg(
        *aggs,
        F.regr_count(value, "before").alias("pair_n"),
        F.regr_avgx(value, "before").alias("pair_x"),
        F.regr_avgy(value, "before").alias("pair_y"),
        F.regr_sxx(value, "before").alias("pair_xx"),
        F.regr_sxy(value, "before").alias("pair_xy"),
        F.max(F.when(place == 0, F.col(value))).alias("opens"),
        F.max(F.when(place == per_day - 1, F.col(value))).alias("closes"),
    )


def midnight_pairs(states: DataFrame) -> DataFrame:
    """A pair state for every midnight with a value on both sides."""
    # Both sides of a midnight meet by (site, day), so no site is one task.
    ends = states.select(SITE, (F.col("day") + 1).alias("day"), F.col("closes").alias("x"), F.lit(None).cast("double").alias("y"))
    starts = states.select(SITE, "day", F.lit(None).cast("double").alias("x"), F.col("opens").alias("y"))
    met = ends.unionByName(starts).groupBy(SITE, "day").agg(F.max("x").alias("pair_x"), F.max("y").alias("pair_y"))
    zero = F.lit(0.0)
    return met.filter("pair_x IS NOT NULL AND pair_y IS NOT NULL").select(
        SITE,
        F.lit(1).cast("bigint").alias("pair_n"),
        "pair_x",
        "pair_y",
        zero.alias("pair_xx"),
        zero.alias("pair_xy"),
    )


def fit_from_states(
    states: DataFrame, cols: Sequence[str] = SCALED, value: str = TARGET, ddof: int = 1
) -> DataFrame:
    """Per site `{c}_n`, `{c}_mean`, `{c}_std`, and `a`, `b`, `n_pairs` of the raw series' AR(1).

    States merge by the pairwise rule: means first, then squared deviations about them, so
    series that hardly vary about a large mean keep their digits.
    """
    parts = states.select(SITE, *[f"{c}_{s}" for c in cols for s in ("n", "mean", "m2")], *PAIR)
    parts = parts.unionByName(midnight_pairs(states), allowMissingColumns=True)

    def mean(of: str, n: str) -> Column:
        return F.sum(F.col(of) * F.col(n)) / F.nullif(F.sum(n), F.lit(0))

    means = parts.groupBy(SITE).agg(
        *[mean(f"{c}_mean", f"{c}_n").alias(f"{c}_all") for c in cols],
        mean("pair_x", "pair_n").alias("x_all"),
        mean("pair_y", "pair_n").alias("y_all"),
    )
    beside = attach_by_site(parts, means)
    x, y = F.col("pair_x") - F.col("x_all"), F.col("pair_y") - F.col("y_all")
    aggs = []
    for c in cols:
        off = F.col(f"{c}_mean") - F.col(f"{c}_all")
        aggs += [
            F.coalesce(F.sum(f"{c}_n"), F.lit(0)).cast("bigint").alias(f"{c}_n"),
            F.first(f"{c}_all").alias(f"{c}_mean"),
            F.sum(F.col(f"{c}_m2") + F.col(f"{c}_n") * off * off).alias(f"{c}_m2"),
        ]
    merged = beside.groupBy(SITE).agg(
        *aggs,
        F.coalesce(F.sum("pair_n"), F.lit(0)).cast("bigint").alias("n_pairs"),
        F.first("x_all").alias("x"),
        F.first("y_all").alias("y"),
        F.sum(F.col("pair_xx") + F.col("pair_n") * x * x).alias("xx"),
        F.sum(F.col("pair_xy") + F.col("pair_n") * x * y).alias("xy"),
    )
    spread = [
        F.sqrt(F.when(F.col(f"{c}_n") > ddof, F.col(f"{c}_m2") / (F.col(f"{c}_n") - ddof))).alias(f"{c}_std")
        for c in cols
    ]
    # As in `models.regression`: without a usable slope the model is the mean level.
    slope = F.col("xy") / F.when(F.col("xx") > 0, F.col("xx"))
    level = F.coalesce(F.col("y") - slope * F.col("x"), F.col(f"{value}_mean"), F.lit(0.0))
    return merged.select(
        SITE,
        *[F.col(f"{c}_{s}") for c in cols for s in ("n", "mean")],
        *spread,
        level.alias("a"),
        F.coalesce(slope, F.lit(0.0)).alias("b"),
        "n_pairs",
    )


def scaled_model(fit: DataFrame, value: str = TARGET) -> DataFrame:
    """The fit with `a` for the scaled series, as `models.fit_scaled_ar1` gives it."""
    mean, std = F.col(f"{value}_mean"), F.col(f"{value}_std")
    moved = F.coalesce((F.col("a") + (F.col("b") - 1) * mean) / std, F.lit(0.0))
    return fit.withColumn("a", F.when(std > MIN_STD, moved).otherwise(F.col("a")))
