"""Readings files with bad rows in them: what can be read, what was left out, and why."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitecast.functions.values import NA_TEXT, nan_to_null
from sitecast.schema import ENCODER, SITE
from sitecast.sources.checkpoints import cut

RAW = "_raw_line"
LINE_LENGTH = "number of fields"


@dataclass
class Checked:
    """A readings file: good rows, rejected ones (file, line, reasons), and counts of both.

    `counts` holds `lines`, `rejected`, `without_site` (good rows that have no site, which no
    series takes in) and `missing_<feature>` of the good rows.
    """

    readings: DataFrame
    rejects: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def read_number(text: Column) -> tuple[Column, Column]:
    """Text to DOUBLE, and whether the text is neither a number nor a spelling of missing."""
    trimmed = F.trim(text)
    said = F.when(~trimmed.isin(NA_TEXT), trimmed)
    value = said.try_cast("double")
    return nan_to_null(value), said.isNotNull() & value.isNull()


def judge_rows(raw: DataFrame, site: str, ts: str, features: Sequence[str]) -> DataFrame:
    """Text rows to typed ones with `reasons`, empty for a good row.

    A row is bad if its line has too few or too many fields (`RAW` is filled then), if a value
    is no number and no spelling of missing, if the site is no whole number, or if a row with a
    site has no readable moment.
    """
    key, bad_key = read_number(F.col(site))
    moment = F.col(ts).try_cast("timestamp_ntz")
    whole = key.try_cast("int")
    bad_site = bad_key | (key.isNotNull() & (whole.isNull() | (whole != key)))
    numbers = {c: read_number(F.col(c)) for c in features}
    reasons = [
        F.when(F.col(RAW).isNotNull(), LINE_LENGTH),
        F.when(bad_site, site),
        F.when((key.isNotNull() | bad_site) & moment.isNull(), ts),
        *[F.when(bad, c) for c, (_, bad) in numbers.items()],
    ]
    # A line with the wrong number of fields says nothing else for certain.
    reasons = F.when(F.col(RAW).isNotNull(), F.array(F.lit(LINE_LENGTH))).otherwise(F.array_compact(F.array(*reasons)))
    text = F.coalesce(F.col(RAW), F.to_csv(F.struct(*[c for c in raw.columns if c not in (RAW, "_file")])))
    return raw.select(
        whole.alias(SITE),
        moment.alias("ts"),
        *[value.alias(c) for c, (value, _) in numbers.items()],
        reasons.alias("reasons"),
        F.when(F.size(reasons) > 0, text).alias("line"),
        "_file",
    )


def read_checked(
    spark: SparkSession,
    path: str,
    site: str = "CampusKey",
    ts: str = "ts",
    features: Sequence[str] = ENCODER,
) -> Checked:
    """Reads a readings CSV once, bad rows apart from good ones.

    Columns are found by name; files of one path must have the same header. The rows are stored
    in the shared folder in the pass that counts them, so nothing reads the file again.
    """
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    absent = [c for c in [site, ts, *features] if c not in names]
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RAW]])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW)
        .option("columnPruning", False)  # or fields beyond the wanted ones would not be counted
        .option("enforceSchema", False)
        .csv(path)
        .withColumn("_file", F.input_file_name())
    )
    good = F.size("reasons") == 0
    seen = Observation()

    def count(what: Column) -> Column:
        return F.count(F.when(what, 1))

    rows = judge_rows(raw, site, ts, features).observe(
        seen,
        F.count(F.lit(1)).alias("lines"),
        count(~good).alias("rejected"),
        count(good & F.col(SITE).isNull()).alias("without_site"),
        *[count(good & F.col(c).isNull()).alias(f"missing_{c}") for c in features],
    )
    stored = cut(rows)
    return Checked(
        stored.filter(good).select(SITE, "ts", *features),
        stored.filter(~good).select(F.col("_file").alias("file"), "line", "reasons"),
        {k: int(v) for k, v in seen.get.items()},
    )
