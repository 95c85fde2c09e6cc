"""Missing values, sentinels, scaling and clipping as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitecast.schema import MIN_STD

# The spellings a CSV reader of the pandas family takes for missing.
NA_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def nan_to_null(col: Column) -> Column:
    """NaN means missing in the files, NULL means missing in the tables."""
    return F.when(~F.isnan(col), col)


def parse_number(text: Column) -> Column:
    """Text cell to DOUBLE; every spelling of missing becomes NULL."""
    text = F.trim(text)
    return nan_to_null(F.when(~text.isin(NA_TEXT), text).cast("double"))


def is_missing(col: Column) -> Column:
    return col.isNull()


def to_sentinel(col: Column, sentinel: float) -> Column:
    return F.coalesce(col, F.lit(sentinel))


def from_sentinel(col: Column, sentinel: float) -> Column:
    return F.nullif(col, F.lit(sentinel))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Standardise, but leave the value raw where the spread is unknown or nil."""
    return F.when(std > MIN_STD, (x - mean) / std).otherwise(x)


def undo_zscore(x: Column, mean: Column, std: Column) -> Column:
    """Inverse scaling; an unknown site counts as mean 0, spread 1."""
    return x * F.coalesce(std, F.lit(1.0)) + F.coalesce(mean, F.lit(0.0))


def clip_nonneg(col: Column) -> Column:
    """Negative power is impossible; a missing forecast stays missing."""
    return F.when(col.isNotNull(), F.greatest(col, F.lit(0.0)))
