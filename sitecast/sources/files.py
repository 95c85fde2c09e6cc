"""Readings, statistics, result and model files."""

import warnings
from collections.abc import Sequence

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitecast.functions.values import parse_number
from sitecast.operators.chunks import attach_by_site
from sitecast.operators.grid import to_grid
from sitecast.operators.scaling import scale_by_site
from sitecast.schema import ENCODER, SCALED, SITE
from sitecast.sources import versions
from sitecast.sources.checked import read_checked
from sitecast.sources.versions import exists

_MOMENTS = T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])
STATS_JSON = T.MapType(T.StringType(), T.MapType(T.StringType(), _MOMENTS))


def clean_readings(
    raw: DataFrame, site: str = "CampusKey", ts: str = "ts", features: Sequence[str] = ENCODER
) -> DataFrame:
    """Text columns to typed readings; every spelling of missing becomes NULL."""
    return raw.select(
        parse_number(F.col(site)).cast("int").alias(SITE),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        *[parse_number(F.col(c)).alias(c) for c in features],
    )


def read_readings(
    spark: SparkSession,
    path: str,
    site: str = "CampusKey",
    ts: str = "ts",
    features: Sequence[str] = ENCODER,
) -> DataFrame:
    """Readings CSV with a header line; columns are found by name, others are ignored.

    Where `path` names several files, their headers must agree: one that differs is an error
    when its rows are read, so that no column takes the place of another.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    raw = reader.option("enforceSchema", False).csv(path)
    absent = [c for c in [site, ts, *features] if c not in raw.columns]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    return clean_readings(raw, site, ts, features)


def parse_stats(texts: DataFrame, col: str = "value") -> DataFrame:
    """JSON `{site: {feature: {mean, std}}}` per row to (site, feature, mean, std)."""
    sites = texts.select(F.explode(F.from_json(col, STATS_JSON)).alias(SITE, "features"))
    feature = sites.select(SITE, F.explode("features").alias("feature", "moments"))
    return feature.select(SITE, "feature", "moments.mean", "moments.std")


def format_stats(long: DataFrame) -> DataFrame:
    """The inverse of `parse_stats`: one JSON text per site."""
    entry = F.struct("feature", F.struct("mean", "std"))
    per_site = long.groupBy(F.col(SITE).cast("string").alias(SITE)).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("features")
    )
    return per_site.select(SITE, F.to_json(F.create_map(SITE, "features")).alias("value"))


def read_stats(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Scaler file to rows: one JSON document (however indented), or one per line."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return parse_stats(spark.read.text(path, wholetext=not lines))


def write_stats(long: DataFrame, path: str) -> None:
    """Scaler rows to JSON, a line per site."""
    format_stats(long).select("value").write.mode("overwrite").text(path)


def load_datasets(
    spark: SparkSession,
    paths: dict[str, str],
    stats: DataFrame,
    required: Sequence[str] = (),
    cols: Sequence[str] = SCALED,
    report: dict[str, dict] | None = None,
    **columns,
) -> DataFrame:
    """Read, grid and scale several readings files into one table with a `dataset` column.

    A missing optional file is skipped with a warning, a missing required one is an error,
    and so is a file that scaling leaves without rows. Every file is read once. Rows that cannot
    be read are left out with a warning; `report` gets the counts of what each file lost by data
    set name: those of `checked.read_checked`, `unknown_sites`, `unknown_site_rows`, and the
    rejected rows themselves as the table `rejects`.
    """
    parts = []
    for name, path in paths.items():
        if not exists(spark, path):
            if name in required:
                raise FileNotFoundError(path)
            warnings.warn(f"{name}: {path} not found, skipped", stacklevel=2)
            continue
        found = read_checked(spark, path, **columns)
        lost = found.counts["rejected"]
        if lost:
            warnings.warn(f"{name}: {lost} of {found.counts['lines']} rows cannot be read", stacklevel=2)
        per_site = found.readings.filter(F.col(SITE).isNotNull()).groupBy(SITE).agg(F.count("*").alias("rows"))
        known = stats.select(SITE).distinct().withColumn("known", F.lit(True))
        strange = attach_by_site(per_site, known, how="left").agg(
            F.count(F.when(F.col("known"), 1)).alias("sites"),
            F.count(F.when(F.col("known").isNull(), 1)).alias("unknown_sites"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("rows"))), F.lit(0)).alias("unknown_site_rows"),
        ).first()
        if report is not None:
            report[name] = {**found.counts, "rejects": found.rejects}
            report[name] |= {k: strange[k] for k in ("unknown_sites", "unknown_site_rows")}
        if not strange["sites"]:
            raise ValueError(f"{name}: no rows left after scaling")
        scaled = scale_by_site(to_grid(found.readings), stats, cols)
        parts.append(scaled.withColumn("dataset", F.lit(name)))
    if not parts:
        raise FileNotFoundError("none of the data sets exists")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_results(df: DataFrame, path: str) -> None:
    """Result table, a directory per data set; inside, rows of a site lie together.

    Sites are no directories: there may be very many of them.
    """
    near = [c for c in (SITE, "start_idx", "step") if c in df.columns]
    out = df.sortWithinPartitions("dataset", *near)
    out.write.mode("overwrite").partitionBy("dataset").parquet(path)


def save_model(model: DataFrame | LinearRegressionModel, path: str, keep: int = versions.KEEP) -> None:
    """Coefficient table or fitted linear model, as a new version under `path`.

    The model saved before stays current until the new one is whole, and the last `keep` are
    kept.
    """

    def write(folder: str) -> None:
        if isinstance(model, DataFrame):
            model.write.parquet(folder)
        else:
            model.write().save(folder)

    versions.commit(SparkSession.getActiveSession(), path, write, keep)


def load_model(spark: SparkSession, path: str, back: int = 0) -> DataFrame | LinearRegressionModel:
    """The current model under `path`, or the one saved `back` times before it.

    A folder that holds a model itself, without versions, is read as it is.
    """
    kept = versions.earlier(spark, path)
    if back and back >= len(kept):
        raise FileNotFoundError(f"{path}: no model {back} versions back")
    folder = kept[-1 - back] if kept else path
    if not exists(spark, folder):
        raise FileNotFoundError(path)
    if exists(spark, f"{folder}/metadata"):
        return LinearRegressionModel.load(folder)
    return spark.read.parquet(folder)
