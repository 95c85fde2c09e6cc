"""Grid completion, as-of weather and data age."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.functions import clock
from sitecast.operators.chunks import running
from sitecast.schema import CHUNK, ENCODER, SITE, SLOT_MICROS


def site_bounds(df: DataFrame, align: int = 1) -> DataFrame:
    """First slot and row count of every site, widened to multiples of `align` slots."""
    first = F.expr(f"min(slot) - pmod(min(slot), {align})")
    end = F.expr(f"max(slot) - pmod(max(slot), {align}) + {align}")
    return df.groupBy(SITE).agg(first.alias("first_slot"), (end - first).alias("n_rows"))


def fixed_bounds(sites: DataFrame, start: Column, end: Column, width: int = SLOT_MICROS) -> DataFrame:
    """The same bounds for every site; readings outside are left out of the grid."""
    first = clock.slot_floor(clock.micros(start), width)
    last = clock.slot_ceil(clock.micros(end), width)
    return sites.select(SITE).distinct().select(
        SITE, first.alias("first_slot"), (last - first).alias("n_rows")
    )


def complete_grid(
    df: DataFrame, bounds: DataFrame, aggs: dict[str, Column], width: int = SLOT_MICROS
) -> DataFrame:
    """One row per site and slot; slots without readings become NULL rows.

    The empty grid is unioned with the readings and both go through one aggregate, so the
    readings are combined before the only shuffle and no join is needed. The grid itself is
    unfolded chunk by chunk, so a long site is produced by many tasks. Their number is the
    session's: blocks are small and grow a thousandfold, so merged by size they would all meet
    in one task, whose aggregate would hold the whole grid.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bounds.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_rows - 1) div {CHUNK}")))
    ).repartition(tasks, SITE, "block")
    first = F.col("block") * CHUNK
    last = F.least(first + CHUNK, F.col("n_rows")) - 1
    empty = blocks.withColumn("place", F.explode(F.sequence(first, last))).select(
        SITE, (F.col("first_slot") + F.col("place")).alias("slot"), "first_slot", "n_rows"
    )
    merged = (
        df.filter(F.col(SITE).isNotNull())
        .unionByName(empty, allowMissingColumns=True)
        .groupBy(SITE, "slot")
        .agg(
            F.max("first_slot").alias("first_slot"),
            F.max("n_rows").alias("n_rows"),
            *[col.alias(name) for name, col in aggs.items()],
        )
        .filter(F.col("first_slot").isNotNull())
    )
    # Keys that Spark knows to be present need no join filters, so every use of the grid in a
    # job has the same plan below it and the shuffle is done once.
    present = F.lit(-1).cast("bigint")
    return merged.select(
        F.coalesce(F.col(SITE), F.lit(-1)).alias(SITE),
        F.coalesce(F.col("slot") - F.col("first_slot"), present).alias("row_idx"),
        F.coalesce(F.col("n_rows"), present).alias("n_rows"),
        clock.slot_start(F.col("slot"), width).alias("ts"),
        *aggs,
    )


def to_grid(readings: DataFrame, cols: Sequence[str] = ENCODER, bounds: DataFrame | None = None) -> DataFrame:
    """Readings to one row per site and 15-minute slot; readings of one slot are averaged.

    Without `bounds` a site's grid reaches from its first to its last reading. Readings without
    a site are left out; one without a timestamp has no place in a series and is an error.
    """
    known = readings.filter(F.col(SITE).isNotNull())
    gone = F.raise_error(F.lit("a reading of a site has no timestamp")).cast("bigint")
    slot = F.coalesce(clock.slot_floor(clock.micros(F.col("ts"))), gone)
    slotted = known.select(SITE, slot.alias("slot"), *cols)
    bounds = site_bounds(slotted) if bounds is None else bounds
    return complete_grid(slotted, bounds, {c: F.avg(c) for c in cols})


def latest_per_slot(updates: DataFrame, values: Sequence[str], width: int = SLOT_MICROS) -> DataFrame:
    """Per site and slot, the newest value (and its moment) that the slot start can know.

    `updates` has `us` (moment) and `tie` (breaks equal moments). Each update is booked on the
    first slot that starts at or after it, so a plain aggregate replaces the range condition.
    """
    aggs = []
    for name in values:
        order = F.when(F.col(name).isNotNull(), F.struct("us", "tie"))
        aggs.append(F.max_by(F.struct(F.col(name).alias("value"), "us"), order).alias(name))
    return (
        updates.withColumn("slot", clock.slot_ceil(F.col("us"), width)).groupBy(SITE, "slot").agg(*aggs)
    )


def asof_hourly(
    grid: DataFrame, updates: DataFrame, values: Sequence[str], width: int = SLOT_MICROS
) -> DataFrame:
    """Latest value with update moment <= slot start, no interpolation.

    Adds the values and `{value}_us`, the moment each of them became known.
    """
    slot = clock.slot_floor(clock.micros(F.col("ts")), width)
    latest = latest_per_slot(updates, values, width)
    latest = latest.select(SITE, (F.col("slot") * 2).alias("turn"), *values)
    rows = grid.withColumn("turn", slot * 2 + 1).unionByName(latest, allowMissingColumns=True)
    folds = {f"{name}_asof": (name, "last") for name in values}
    found = running(rows, folds, idx="turn", levels=2, carriers=latest)
    return found.filter(F.col("row_idx").isNotNull()).select(
        *grid.columns,
        *[F.col(f"{name}_asof.value").alias(name) for name in values],
        *[F.col(f"{name}_asof.us").alias(f"{name}_us") for name in values],
    )


def minutes_since(ts: Column, known_us: Column) -> Column:
    """Whole minutes between a reading and the update it relies on."""
    return F.floor((clock.micros(ts) - known_us) / 60_000_000).cast("double")
