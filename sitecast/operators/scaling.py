"""Per-site statistics, scaling and its inverse, power rescaling, night fill."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.functions import values as V
from sitecast.operators.chunks import attach_by_site
from sitecast.schema import DECODER, ENCODER, SCALED, SITE, TARGET, WEATHER


def fit_stats(df: DataFrame, cols: Sequence[str] = SCALED, ddof: int = 1) -> DataFrame:
    """Mean and spread per site, one wide row each: `{feature}_mean`, `{feature}_std`."""
    spread = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), spread(c).alias(f"{c}_std")]
    return df.groupBy(SITE).agg(*aggs)


def stats_long(wide: DataFrame, cols: Sequence[str] = SCALED) -> DataFrame:
    """Wide statistics to (site, feature, mean, std)."""
    parts = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"{c}_mean").alias("mean"),
                F.col(f"{c}_std").alias("std"),
            )
            for c in cols
        ]
    )
    return wide.select(SITE, F.inline(parts))


def stats_wide(long: DataFrame, cols: Sequence[str] = SCALED) -> DataFrame:
    """(site, feature, mean, std) to one row per site; absent features become NULL."""
    aggs = []
    for c in cols:
        here = F.col("feature") == c
        aggs += [
            F.max(F.when(here, F.col("mean"))).alias(f"{c}_mean"),
            F.max(F.when(here, F.col("std"))).alias(f"{c}_std"),
        ]
    return long.groupBy(SITE).agg(*aggs)


def fill_weather(df: DataFrame, cols: Sequence[str] = WEATHER) -> DataFrame:
    """Missing weather counts as raw 0, before scaling."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def scale_by_site(df: DataFrame, stats: DataFrame, cols: Sequence[str] = SCALED) -> DataFrame:
    """Fill weather, then standardise with the site's own statistics.

    Sites without statistics and rows without a site drop out; a missing target stays missing.
    """
    kept = df.columns
    filled = fill_weather(df, [c for c in cols if c in WEATHER])
    joined = attach_by_site(filled, stats)
    scaled = {c: V.zscore(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std")) for c in cols}
    return joined.withColumns(scaled).select(*kept)


def unscale(df: DataFrame, stats: DataFrame, col: str, feature: str = TARGET) -> DataFrame:
    """Back to kW; rows of unknown sites pass with mean 0 and spread 1."""
    site = stats.select(SITE, f"{feature}_mean", f"{feature}_std")
    joined = attach_by_site(df, site, how="left")
    raw = V.undo_zscore(F.col(col), F.col(f"{feature}_mean"), F.col(f"{feature}_std"))
    return joined.withColumn(col, raw).select(*df.columns)


def rescale_power(df: DataFrame, top: float = 20.0, col: str = TARGET) -> DataFrame:
    """Linear rescale so that the site's observed peak becomes `top` kW."""
    peaks = df.groupBy(SITE).agg(F.max(col).alias("peak"))
    scaled = F.col(col) / F.nullif(F.col("peak"), F.lit(0.0)) * top
    return attach_by_site(df, peaks).withColumn(col, scaled).select(*df.columns)


def fill_night(df: DataFrame, zenith: Column, limit: float = 90.0, col: str = TARGET) -> DataFrame:
    """A gap with the sun at or below the horizon is 0; any other gap stays missing."""
    dark = F.col(col).isNull() & (zenith >= limit)
    return df.withColumn(col, F.when(dark, 0.0).otherwise(F.col(col)))


def ordered(df: DataFrame) -> DataFrame:
    """Rows in reading order; for the last step before a sink, nothing else depends on order."""
    return df.orderBy(SITE, "row_idx")


def feature_vectors(df: DataFrame) -> DataFrame:
    """Encoder (10) and decoder (5) row vectors in their fixed order."""
    return df.select(
        SITE, "row_idx", F.array(*ENCODER).alias("encoder"), F.array(*DECODER).alias("decoder")
    )
