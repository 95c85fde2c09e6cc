"""Continuous valid segments and gap ordinals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sitecast.operators.chunks import KEYS, chunk_window, drop_halo, with_halo
from sitecast.operators.sequences import cells, samples
from sitecast.schema import CHUNK, TARGET


def run_reach(m: int) -> int:
    """Rows that `mark_run_ends` looks back."""
    return 2 * (m - 1)


def mark_run_ends(framed: DataFrame, w: WindowSpec, m: int, value: str = TARGET) -> DataFrame:
    """Add `run_end`: the newest of the last `m` rows (this one included) that closes `m`
    valid rows in a row, NULL where there is none."""
    full = F.count(F.col(value)).over(w.rowsBetween(1 - m, 0)) == m
    framed = framed.withColumn("closes", F.when(full, F.col("row_idx")))
    return framed.withColumn("run_end", F.max("closes").over(w.rowsBetween(1 - m, 0))).drop("closes")


def in_segment(y: Column, run_end: Column, first_row: Column | int, m: int) -> Column:
    """Valid cell within `m` rows after the close of a run that lies inside the sample.

    `first_row` is the sample's first row: a run may not begin before it.
    """
    return y.isNotNull() & F.coalesce(run_end >= first_row + (m - 1), F.lit(False))


def continuous_segments(
    df: DataFrame,
    m: int = 3,
    mode: str = "reference",
    value: str = TARGET,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
) -> DataFrame:
    """Flag the valid rows of continuous segments over each series.

    `reference`: rows from the close of a run of `m` valid rows onward, `m` rows each (so the
    first `m - 1` rows of a run are left out and valid rows soon after a gap can be in).
    `run`: every row of a run of at least `m` valid rows.
    """
    w = chunk_window(keys)
    if mode == "reference":
        framed = mark_run_ends(with_halo(df, before=run_reach(m), width=width), w, m, value)
        flag = in_segment(F.col(value), F.col("run_end"), F.lit(0), m)
        return drop_halo(framed.withColumn("in_segment", flag).drop("run_end"), width)
    if mode != "run":
        raise ValueError(f"unknown mode {mode!r}")
    framed = with_halo(df, before=m - 1, after=m - 1, width=width)
    full = F.count(F.col(value)).over(w.rowsBetween(1 - m, 0)) == m
    framed = framed.withColumn("closes", full.cast("int"))
    flag = F.coalesce(F.max("closes").over(w.rowsBetween(0, m - 1)) == 1, F.lit(False))
    return drop_halo(framed.withColumn("in_segment", flag).drop("closes"), width)


def count_gaps(framed: DataFrame, w: WindowSpec, value: str = TARGET) -> DataFrame:
    """Add `gaps`, a running count of missing rows; only differences inside a chunk matter."""
    missing = F.col(value).isNull().cast("int")
    return framed.withColumn("gaps", F.sum(missing).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_samples(
    df: DataFrame, value: str = TARGET, keep: Sequence[str] = (), keys: Sequence[str] = KEYS, **kw
) -> DataFrame:
    """Samples with `gap_count`, the number of missing steps in the horizon."""
    found = samples(
        df,
        value,
        extra=["gaps"],
        keep=[*keep, "gaps"],
        derive=lambda framed, w: count_gaps(framed, w, value),
        keys=keys,
        **kw,
    )
    last = F.element_at("ahead", -1)["gaps"]
    return found.withColumn("gap_count", last - F.col("gaps")).withColumnRenamed("gaps", "gaps_at_seed")


def gap_ordinals(sample: DataFrame) -> DataFrame:
    """Cells with `ordinal`, the rank of a missing step among its sample's gaps."""
    ranked = F.when(F.col("y").isNull(), F.col("gaps") - F.col("gaps_at_seed"))
    return cells(sample, ["gaps"]).withColumn("ordinal", ranked).drop("gaps", "gaps_at_seed")


def fill_rounds(sample: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rounds each batch needs: the largest gap count among its samples."""
    return sample.groupBy(*keys, "batch_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("gap_count").alias("rounds")
    )


def with_rounds(sample: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same beside every sample (a batch holds at most its fixed number of samples)."""
    w = Window.partitionBy(*keys, "batch_id")
    return sample.withColumn("rounds", F.max("gap_count").over(w))
