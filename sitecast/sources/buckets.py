"""Tables whose rows lie in buckets of their join keys, so that joins on these keys move nothing.

Spark keeps what it knows about buckets in its catalog, not in the files. So a table is named
for the session that reads it, and the folder alone is what is stored.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ROWS_PER_BUCKET = 500_000


def bucket_count(spark: SparkSession, n_rows: int, rows: int = ROWS_PER_BUCKET) -> int:
    """Buckets of about `rows` rows, and no fewer than a shuffle has parts."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows))


def write_bucketed(df: DataFrame, folder: str, keys: Sequence[str], buckets: int) -> None:
    """Stores the rows in `folder`, in `buckets` buckets sorted by the keys.

    Rows that lie by bucket already, as those read from another such table do, are not moved.
    """
    spark = df.sparkSession
    name = f"writing_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", folder)
    try:
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_bucketed(
    spark: SparkSession, folder: str, keys: Sequence[str], buckets: int, schema: StructType | None = None
) -> DataFrame:
    """The rows of `folder`, known to lie by bucket; keys and number as they were written."""
    schema = schema or spark.read.parquet(folder).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    name = f"reading_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{folder}'"
    )
    return spark.table(name)


def forget(df: DataFrame) -> None:
    """Drops the session's name of a table that `read_bucketed` gave; its files stay."""
    for name in {t.name for t in df.sparkSession.catalog.listTables() if t.name.startswith("reading_")}:
        if name in df._jdf.queryExecution().analyzed().toString():
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
