"""Cutting the lineage of iterative jobs through storage all executors can reach."""

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it in spark.checkpoint.dir."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # One machine holds driver and tasks; its warehouse is the folder they share.
        wanted = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    spark.sparkContext.setCheckpointDir(wanted)
    return wanted


def cut(df: DataFrame) -> DataFrame:
    """The same rows, stored, with no history behind them."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
