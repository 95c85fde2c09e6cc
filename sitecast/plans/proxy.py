"""Readings derived from the supplied tables.

`events` is the series source: thirty neighbouring users make a site, so the number of sites
grows with the data. `lineitem` and `supplier` give a second, daily series per supplier with
the supplier's nation as its city. Site places are invented.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.functions import clock
from sitecast.operators import grid as G
from sitecast.plans import prepare
from sitecast.schema import ENCODER, SITE, SLOTS_PER_DAY, TARGET

USERS_PER_SITE = 30
DAY_MICROS = 24 * 3600 * 1_000_000

# Declared, so that Spark need not open files to learn it.
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LINEITEM = "l_suppkey bigint, l_shipdate timestamp_ntz, l_extendedprice double"
SUPPLIER = "s_suppkey bigint, s_nationkey int"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = clock.micros(F.col("ts"))
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").select(
        F.expr(f"user_id div {USERS_PER_SITE} + 1").cast("int").alias(SITE),
        "event_id",
        "ts",
        us.alias("us"),
        clock.slot_floor(us).alias("slot"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def day_bounds(ev: DataFrame) -> DataFrame:
    """The series of a site covers whole days, from its first event's to its last one's."""
    return G.site_bounds(ev, align=SLOTS_PER_DAY)


def places(df: DataFrame) -> DataFrame:
    """Invented latitude and longitude of every site."""
    return df.select(SITE).distinct().select(
        SITE,
        (F.lit(-10.0) - F.col(SITE) * 7 % 30).alias("lat"),
        (F.lit(110.0) + F.col(SITE) * 11 % 45).alias("lon"),
    )


def target_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded target only: mean event value per site and slot."""
    ev = events(spark, sf_dir)
    return G.complete_grid(ev.select(SITE, "slot", "value"), day_bounds(ev), {TARGET: F.avg("value")})


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per site, without building the grid."""
    return day_bounds(events(spark, sf_dir)).select(SITE, "n_rows")


def hourly_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irradiance (purchases) and cloud (signups) updates, at irregular moments."""
    ev = events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup"))
    return ev.select(
        SITE,
        "us",
        F.col("event_id").alias("tie"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("Ghi_hourly"),
        F.when(F.col("event_type") == "signup", F.col("k")).alias("CloudOpacity_hourly"),
    )


def station_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gridded 15-minute columns: target, temperature (views), humidity (clicks)."""
    ev = events(spark, sf_dir)
    columns = {
        TARGET: F.col("value"),
        "AirTemperature": F.when(F.col("event_type") == "view", F.col("k")),
        "RelativeHumidity": F.when(F.col("event_type") == "click", F.col("k")),
    }
    slotted = ev.select(SITE, "slot", *[c.alias(n) for n, c in columns.items()])
    return G.complete_grid(slotted, day_bounds(ev), {n: F.avg(n) for n in columns})


def slotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns per site and slot with an event, without the empty slots."""
    ev = events(spark, sf_dir)
    return ev.groupBy(SITE, "slot").agg(
        F.avg("value").alias(TARGET),
        F.avg(F.when(F.col("event_type") == "view", F.col("k"))).alias("AirTemperature"),
        F.avg(F.when(F.col("event_type") == "click", F.col("k"))).alias("RelativeHumidity"),
    )


def with_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station grid with the latest hourly values and the age of the irradiance."""
    found = G.asof_hourly(
        station_grid(spark, sf_dir),
        hourly_updates(spark, sf_dir),
        ["Ghi_hourly", "CloudOpacity_hourly"],
    )
    age = G.minutes_since(F.col("ts"), F.col("Ghi_hourly_us"))
    return found.withColumn("minutes_since_last_update", age)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten features on the grid."""
    full = prepare.cycle_features(with_weather(spark, sf_dir))
    full = prepare.solar_position(full, places(events(spark, sf_dir)))
    return full.select(SITE, "row_idx", "n_rows", "ts", *ENCODER)


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue per supplier, gridded by day, with the supplier's nation as `city`."""
    lines = spark.read.schema(LINEITEM).parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("int").alias(SITE),
        clock.slot_floor(clock.micros(F.col("l_shipdate")), DAY_MICROS).alias("slot"),
        "l_extendedprice",
    )
    return G.complete_grid(
        lines, G.site_bounds(lines), {TARGET: F.sum("l_extendedprice")}, DAY_MICROS
    )


def supplier_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(SUPPLIER).parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").cast("int").alias(SITE), F.col("s_nationkey").alias("city")
    )
