"""Helpers that several operators share."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitecast.sources.checkpoints import checkpoint_dir, cut

__all__ = ["bytes_of", "cut", "free_name", "numbered", "quoted", "shared_path", "ship", "stored", "table", "words_of"]

# Words are runs of characters that are not ASCII white space (space, \t \n \x0B \f \r).
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package's modules to the Python workers of the session, once."""
    context = spark.sparkContext
    if getattr(context, "_sitecast_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="sitecast-"), "sitecast.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._sitecast_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` (stored, with `_row` from monotonically_increasing_id) numbered gaplessly per `key`.

    Numbers are counted within (input partition, key) and shifted by the rows of the cells
    before, so no key is gathered in one task.
    """
    rows = rows.withColumn("_cell", F.shiftright("_row", 33))
    cells = rows.groupBy(key, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    offsets = cells.select(key, "_cell", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_cell").orderBy("_row")) - 1
    return (
        rows.withColumn("_in", inside)
        .join(offsets, [key, "_cell"])
        .withColumn(name, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_cell", "_in", "_before")
    )


def words_of(text: Column) -> Column:
    """Words of a text in order; a NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def bytes_of(text: Column) -> Column:
    """UTF-8 bytes of a text; a NULL text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it (in any case)."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def quoted(name: str) -> Column:
    """The column of this very name, points and all."""
    return F.col("`" + name.replace("`", "``") + "`")
