"""Session settings that suit these jobs."""

from pyspark.sql import SparkSession

# Adaptive execution splits skewed partitions and merges tiny ones; the small minimum keeps
# short but computation-heavy stages (samples unfold twentyfold) from shrinking to one task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
}


def build(builder: SparkSession.Builder) -> SparkSession:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
