"""Exported samples as files of whole batches, with a manifest that says where each batch lies."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.operators.sequences import with_batch
from sitecast.schema import BATCH
from sitecast.sources import versions

BATCHES_PER_FILE = 256
DATA, MANIFEST = "data", "manifest"


def write_shards(sample: DataFrame, path: str, batches_per_file: int = BATCHES_PER_FILE) -> str:
    """Writes numbered samples (`sample_id`, `batch_id`) and their manifest as one version.

    A file holds about `batches_per_file` neighbouring batches, whole and in order of the
    samples. Batches are dealt by ranges, so none is split. The manifest has a row per batch:
    batch_id, file, first_row (place of its first sample in the file, from 0), n_rows,
    first_sample, last_sample; its rows are in files of their own, sorted by batch_id.
    """
    spark = sample.sparkSession

    def write(folder: str) -> dict:
        last = sample.agg(F.max("batch_id")).first()[0]
        files = max(1, -(-((last or 0) + 1) // batches_per_file))
        ordered = sample.repartitionByRange(files, "batch_id").sortWithinPartitions("sample_id")
        return _store(spark, ordered, files, folder)

    return versions.commit(spark, path, write, keep=1)


def write_packed_shards(
    packed: DataFrame,
    unfold: Callable[[DataFrame], DataFrame],
    path: str,
    batches_per_file: int = BATCHES_PER_FILE,
) -> str:
    """The same from packed rows, each of which stands for the samples that start at `lo` to
    `hi`, numbered from its `sample_id` on. `unfold` makes a row's samples (`start_idx`), in this
    order, and keeps the column `offset`, what a sample's number is above its start.

    Packed rows are dealt to files and cut at their bounds; samples, which are a hundred times
    their size, are made where they are written and never moved.
    """
    spark, per_file = packed.sparkSession, batches_per_file * BATCH

    def write(folder: str) -> dict:
        last = packed.agg(F.max(F.expr("sample_id + hi - lo"))).first()[0]
        files = max(1, -(-((last or 0) + 1) // per_file))
        reached = F.sequence(F.expr(f"sample_id div {per_file}"), F.expr(f"(sample_id + hi - lo) div {per_file}"))
        dealt = packed.withColumn("offset", F.expr("sample_id - lo")).withColumn("file", F.explode(reached))
        first = F.col("file") * per_file - F.col("offset")
        dealt = dealt.withColumns({"lo": F.greatest("lo", first), "hi": F.least("hi", first + (per_file - 1))})
        placed = dealt.repartitionByRange(files, "file").sortWithinPartitions("file", F.expr("offset + lo"))
        sample = unfold(placed).withColumn("sample_id", F.col("offset") + F.col("start_idx")).drop("offset")
        return _store(spark, with_batch(sample), files, folder)

    return versions.commit(spark, path, write, keep=1)


def _store(spark: SparkSession, ordered: DataFrame, files: int, folder: str) -> dict:
    # Neighbouring samples repeat each other but for one row, which zstd finds in plain values
    # and not in places of a dictionary.
    plain = {"compression": "zstd", "parquet.enable.dictionary": "false"}
    ordered.write.options(**plain).parquet(f"{folder}/{DATA}")
    rows = spark.read.parquet(f"{folder}/{DATA}").select(
        "batch_id", "sample_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    listed = rows.groupBy("batch_id", "file").agg(
        F.min("row").alias("first_row"),
        F.count("*").alias("n_rows"),
        F.min("sample_id").alias("first_sample"),
        F.max("sample_id").alias("last_sample"),
    )
    listed.repartitionByRange("batch_id").sortWithinPartitions("batch_id").write.parquet(f"{folder}/{MANIFEST}")
    return {"files": files}


def _folder(spark: SparkSession, path: str) -> str:
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(path)
    return folder


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{_folder(spark, path)}/{MANIFEST}")


def read_batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    """The samples of a batch, from the one file that holds it; none for a batch that is not there."""
    place = read_manifest(spark, path).filter(F.col("batch_id") == batch_id).first()
    data = f"{_folder(spark, path)}/{DATA}"
    if place is None:
        return spark.read.parquet(data).limit(0)
    rows = spark.read.parquet(f"{data}/{place['file']}")
    at = F.col("_metadata.row_index")
    return rows.filter((at >= place["first_row"]) & (at < place["first_row"] + place["n_rows"]))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """All samples by the manifest: `place` is the sample's place in its batch, and
    `first_sample`, `last_sample` are what the manifest says of the batch.

    A sample is taken for the batch whose rows of the file hold it, whatever it says itself.

    Both sides meet by file and block of BATCH rows, so the manifest has a row or two per batch.
    It grows with the samples all the same and is merged with them, never sent to every task.
    """
    rows = spark.read.parquet(f"{_folder(spark, path)}/{DATA}").drop("batch_id")
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "*")
    blocks = F.sequence(F.expr(f"first_row div {BATCH}"), F.expr(f"(first_row + n_rows - 1) div {BATCH}"))
    each = read_manifest(spark, path).select(
        "batch_id", "file", "first_sample", "last_sample", F.col("first_row").alias("_from"), F.col("n_rows").alias("_n"), F.explode(blocks).alias("_block")
    )
    met = rows.withColumn("_block", F.expr(f"row div {BATCH}")).join(each.hint("merge"), ["file", "_block"])
    place = F.col("row") - F.col("_from")
    held = met.filter((place >= 0) & (place < F.col("_n"))).withColumn("place", place.cast("int"))
    return held.select(*rows.columns, "batch_id", "first_sample", "last_sample", "place")
