"""Stored day states: a batch of days at a time, the newest batch of a day counts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.schema import SITE
from sitecast.sources import versions

MAX_BATCHES = 32


def add_days(states: DataFrame, root: str, max_batches: int = MAX_BATCHES) -> None:
    """Adds whole days; a day that is there already is replaced. Nothing stored is read, until
    there are `max_batches` batches, which then become one.

    A call that fails leaves the store as it was.
    """
    spark = states.sparkSession
    held = versions.manifest(spark, root)
    number = held["notes"]["batch"] + 1 if held else 0

    def write(folder: str) -> dict:
        states.withColumn("batch", F.lit(number)).write.parquet(folder)
        return {"batch": number}

    versions.commit(spark, root, write, keep=max_batches + 1)
    if len(versions.earlier(spark, root)) > max_batches:
        compact(spark, root)


def read_states(spark: SparkSession, root: str) -> DataFrame:
    """The current state of every (site, day)."""
    folders = versions.earlier(spark, root)
    if not folders:
        raise FileNotFoundError(root)
    rows = spark.read.parquet(*folders)
    if len(folders) == 1:
        return rows.drop("batch")
    kept = [c for c in rows.columns if c not in (SITE, "day", "batch")]
    newest = rows.groupBy(SITE, "day").agg(F.max_by(F.struct(*kept), "batch").alias("state"))
    return newest.select(SITE, "day", "state.*")


def compact(spark: SparkSession, root: str) -> None:
    """All batches into one."""
    held = versions.manifest(spark, root)

    def write(folder: str) -> dict:
        read_states(spark, root).withColumn("batch", F.lit(held["notes"]["batch"])).write.parquet(folder)
        return held["notes"]

    versions.commit(spark, root, write, keep=1)
