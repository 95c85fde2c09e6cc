"""Sliding look-back / horizon samples over gridded series.

A sample starts at `start_idx`, looks back over `lookback` rows and ahead over `horizon`
rows. It is keyed by (site, start_idx) and is never stored 116 times over: everything a
sample needs is read from its last look-back row through bounded frames.
"""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sitecast.functions import values as V
from sitecast.functions.draws import bucket, uniform
from sitecast.operators.chunks import (
    KEYS,
    attach_by_site,
    chunk_window,
    drop_halo,
    running,
    with_halo,
)
from sitecast.schema import (
    BATCH,
    CHUNK,
    ENCODER,
    HORIZON,
    LOOKBACK,
    SENTINEL,
    SITE,
    TARGET,
    TIME,
)

# Picked windows that travel to all tasks; a pick is 116 rows of keys.
MAX_SENT_PICKS = 10_000


def sequence_counts(
    df: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Number of samples per series; too short a series has none."""
    count = F.greatest(F.max("n_rows") - (lookback + horizon - 1), F.lit(0))
    return df.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), count.alias("n_sequences"))


def sequence_index(
    df: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
) -> DataFrame:
    """One row per sample with the number of masked look-back and horizon rows."""
    w = chunk_window(keys)
    missing = V.is_missing(F.col(TARGET)).cast("int")
    framed = with_halo(df.select(*keys, "row_idx", "n_rows", "ts", TARGET), lookback, horizon, width)
    framed = framed.select(
        *keys,
        "chunk_id",
        "row_idx",
        "n_rows",
        F.lag("ts", lookback - 1).over(w).alias("start_ts"),
        F.lead("ts", 1).over(w).alias("horizon_ts"),
        F.sum(missing).over(w.rowsBetween(1 - lookback, 0)).alias("n_src_missing"),
        F.sum(missing).over(w.rowsBetween(1, horizon)).alias("n_tgt_missing"),
    )
    start = (F.col("row_idx") - (lookback - 1)).alias("start_idx")
    return _whole(drop_halo(framed, width), lookback, horizon).select(
        *keys, start, "start_ts", "horizon_ts", "n_src_missing", "n_tgt_missing"
    )


def _whole(df: DataFrame, lookback: int, horizon: int) -> DataFrame:
    """Rows that end a full look-back and have a full horizon ahead."""
    return df.filter(
        (F.col("row_idx") >= lookback - 1) & (F.col("row_idx") < F.col("n_rows") - horizon)
    )


def sample_keys(
    df: DataFrame, lookback: int = LOOKBACK, horizon: int = HORIZON, keys: Sequence[str] = KEYS
) -> DataFrame:
    """The samples alone: every row that has a whole sample behind and ahead of it counts."""
    start = F.col("row_idx") - (lookback - 1)
    return _whole(df, lookback, horizon).select(*keys, start.alias("start_idx"))


def samples(
    df: DataFrame,
    value: str = TARGET,
    extra: Sequence[str] = (),
    keep: Sequence[str] = (),
    derive: Callable[[DataFrame, WindowSpec], DataFrame] | None = None,
    before: int = 0,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
) -> DataFrame:
    """One row per sample: `seed` (value at the last look-back row, missing = 0), the
    `horizon` coming rows as `ahead` (structs of `y` and `extra`), and `keep` columns of the
    last look-back row.

    `derive` may add columns from frames that reach `before` rows back; they share the one
    shuffle and sort with the sample itself.
    """
    w = chunk_window(keys)
    framed = with_halo(df, before, horizon, width)
    if derive is not None:
        framed = derive(framed, w)
    cell = F.struct(F.col(value).alias("y"), *[F.col(c) for c in extra])
    framed = framed.select(
        *dict.fromkeys([*keys, "chunk_id", "row_idx", "n_rows", value, *keep]),
        *[F.lead(cell, k + 1).over(w).alias(f"ahead_{k}") for k in range(horizon)],
    )
    return _whole(drop_halo(framed, width), lookback, horizon).select(
        *keys,
        (F.col("row_idx") - (lookback - 1)).alias("start_idx"),
        *keep,
        F.coalesce(F.col(value), F.lit(0.0)).alias("seed"),
        F.array(*[F.col(f"ahead_{k}") for k in range(horizon)]).alias("ahead"),
    )


def cells(sample: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per sample and step: `y`, `prev` (shifted target, missing = 0) with
    `prev_missing` (its step inside the horizon was missing), and `extra`."""
    kept = [c for c in sample.columns if c != "ahead"]
    long = sample.select(*kept, "ahead", F.posexplode("ahead").alias("step", "cell"))
    earlier = F.coalesce(F.get("ahead", F.col("step") - 1)["y"], F.lit(0.0))
    return long.select(
        *kept,
        "step",
        F.col("cell.y").alias("y"),
        F.when(F.col("step") == 0, F.col("seed")).otherwise(earlier).alias("prev"),
        ((F.col("step") > 0) & F.get("ahead", F.col("step") - 1)["y"].isNull()).alias("prev_missing"),
        *[F.col(f"cell.{c}").alias(c) for c in extra],
    )


def decoder_inputs(df: DataFrame, value: str = TARGET, keys: Sequence[str] = KEYS) -> DataFrame:
    """Known-ahead time features beside the target shifted by one row, missing = 0.

    One lag on the base rows serves every sample that contains the row.
    """
    framed = with_halo(df.select(*keys, "row_idx", *TIME, value), before=1)
    prev = F.coalesce(F.lag(value, 1).over(chunk_window(keys)), F.lit(0.0))
    return drop_halo(framed.withColumn("prev", prev)).select(*keys, "row_idx", *TIME, "prev")


def fill_encoder(df: DataFrame, cols: Sequence[str] = ENCODER) -> DataFrame:
    """After scaling, every missing encoder value counts as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols})


def encoder_summary(
    df: DataFrame,
    cols: Sequence[str] = ENCODER,
    lookback: int = LOOKBACK,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Mean, min, max, last and valid count of the look-back window, per feature.

    Missing values count as 0 in the first four, as the encoder sees them. Keyed by the row
    that ends the window; rows without a full look-back are left out.

    Rows are cut into blocks as long as the window, so a window is the tail of one block and
    the head of the next. Both are running folds, which makes the cost per row independent of
    the length of the look-back.
    """
    width = max(width // lookback, 1) * lookback
    framed = with_halo(df.select(*keys, "row_idx", *keep, *cols), before=lookback, width=width)
    framed = framed.withColumns(
        {"block": F.expr(f"row_idx div {lookback}"), **{f"{c}_valid": F.col(c).isNotNull().cast("int") for c in cols}}
    )
    # One shuffle by chunk serves the windows over blocks and over whole chunks.
    framed = fill_encoder(framed, cols).repartition(*keys, "chunk_id")
    folds = {}
    for c in cols:
        folds[f"{c}_avg"] = (F.sum, c, lambda a, b: a + b)
        folds[f"{c}_min"] = (F.min, c, F.least)
        folds[f"{c}_max"] = (F.max, c, F.greatest)
        folds[f"{c}_valid"] = (F.sum, f"{c}_valid", lambda a, b: a + b)
    block = Window.partitionBy(*keys, "chunk_id", "block")
    head = block.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    tail = block.orderBy(F.col("row_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    framed = framed.select("*", *[f(c).over(tail).alias(f"tail_{n}") for n, (f, c, _) in folds.items()])
    framed = framed.select("*", *[f(c).over(head).alias(f"head_{n}") for n, (f, c, _) in folds.items()])
    w = chunk_window(keys)
    earlier = {f"tail_{n}": F.lag(f"tail_{n}", lookback - 1).over(w) for n in folds}
    full = drop_halo(framed.withColumns(earlier), width).filter(F.col("row_idx") >= lookback - 1)
    whole_block = F.pmod(F.col("row_idx") + 1, F.lit(lookback)) == 0
    out = {
        n: F.when(whole_block, F.col(f"head_{n}")).otherwise(join(F.col(f"tail_{n}"), F.col(f"head_{n}")))
        for n, (_, _, join) in folds.items()
    }
    for c in cols:
        out[f"{c}_avg"] = out[f"{c}_avg"] / lookback
        out[f"{c}_last"] = F.col(c)
    return full.select(*keys, "row_idx", *keep, *[col.alias(n) for n, col in out.items()])


def export_sequences(
    df: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    sentinel: float = SENTINEL,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
) -> DataFrame:
    """Whole samples as nested arrays for an outside trainer (input is scaled readings).

    `src` lookback x 10 with missing = 0, `tgt_in` horizon x 5 with the shifted target,
    `tgt_out` with missing = sentinel, and the two missing masks.
    """
    packed = packed_sequences(df, lookback, horizon, sentinel, keys, width)
    return unfold_sequences(packed, lookback, horizon, keys)


def packed_sequences(
    df: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    sentinel: float = SENTINEL,
    keys: Sequence[str] = KEYS,
    width: int = CHUNK,
) -> DataFrame:
    """The exported samples before they are unfolded: a row per chunk, with the arrays that its
    samples are slices of. Its samples start at the rows `lo` to `hi`; `first` is the row that
    the arrays begin with.

    Samples share nearly all of their rows, so this form is about a hundredth of theirs.
    """
    zero = F.lit(0.0)
    row = F.struct(
        "row_idx",
        F.array(*[F.coalesce(F.col(c), zero) for c in ENCODER]).alias("src"),
        F.array(*TIME).alias("time"),
        F.col(TARGET).alias("y"),
    )
    span = lookback + horizon
    framed = with_halo(df.select(*keys, "row_idx", "n_rows", row.alias("row")), before=span - 1, width=width)
    # A chunk with its margin is a bounded group: it is packed once and every sample that
    # ends in it is a slice of the packed arrays.
    packed = framed.groupBy(*keys, "chunk_id").agg(
        F.max("n_rows").alias("n_rows"), F.array_sort(F.collect_list("row")).alias("rows")
    )
    shifted = F.slice("rows", F.lit(1), F.size("rows") - 1)
    return packed.select(
        *keys,
        "chunk_id",
        F.col("rows")[0]["row_idx"].alias("first"),
        F.greatest(F.col("chunk_id") * width - span + 1, F.lit(0)).alias("lo"),
        (F.least((F.col("chunk_id") + 1) * width, F.col("n_rows")) - span).alias("hi"),
        F.transform("rows", lambda r: r["src"]).alias("src"),
        F.zip_with(
            F.slice("rows", F.lit(2), F.size("rows") - 1),
            shifted,
            lambda r, p: F.concat(r["time"], F.array(F.coalesce(p["y"], zero))),
        ).alias("tgt_in"),
        F.transform("rows", lambda r: V.to_sentinel(r["y"], sentinel)).alias("tgt_out"),
        F.transform("rows", lambda r: V.is_missing(r["y"])).alias("mask"),
    ).filter("hi >= lo")


def unfold_sequences(
    packed: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    keys: Sequence[str] = KEYS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The samples `lo` to `hi` of every packed row, in this order, with the columns `keep`."""
    starts = packed.withColumn("start_idx", F.explode(F.sequence("lo", "hi")))
    at = (F.col("start_idx") - F.col("first") + 1).cast("int")
    return starts.select(
        *keys,
        *keep,
        "start_idx",
        F.slice("src", at, F.lit(lookback)).alias("src"),
        F.slice("tgt_in", at + (lookback - 1), F.lit(horizon)).alias("tgt_in"),
        F.slice("tgt_out", at + lookback, F.lit(horizon)).alias("tgt_out"),
        F.slice("mask", at, F.lit(lookback)).alias("src_mask"),
        F.slice("mask", at + lookback, F.lit(horizon)).alias("tgt_mask"),
    )


def series_offsets(counts: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Samples that precede each series, series taken in site order (per `within` group)."""
    offsets = running(
        counts, {"offset": ("n_sequences", "sum")}, within, idx=SITE, inclusive=False, levels=2
    )
    return offsets.withColumn("offset", F.coalesce("offset", F.lit(0)).cast("bigint"))


def number_samples(sample: DataFrame, offsets: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Add `sample_id`, the running number of the sample over all sites in site order.

    Numbers come from per-site counts, never from a window over all samples.
    """
    if within:
        key = F.concat_ws("|", *within, SITE)
        named = sample.withColumn("series", key)
        sites = offsets.select(key.alias("series"), "offset")
        joined = attach_by_site(named, sites, key="series").drop("series")
    else:
        joined = attach_by_site(sample, offsets.select(SITE, "offset"))
    return joined.withColumn("sample_id", F.col("offset") + F.col("start_idx")).drop("offset")


def with_batch(df: DataFrame, size: int = BATCH) -> DataFrame:
    """Batch of consecutive samples; the last one may be short."""
    return df.withColumn("batch_id", F.expr(f"sample_id div {size}"))


def split_windows(
    df: DataFrame,
    weights: dict[str, float],
    seed: str,
    block: int = 5 * LOOKBACK,
    span: int = LOOKBACK + HORIZON,
) -> DataFrame:
    """Assign samples to splits by drawing whole blocks of rows.

    A sample that touches two blocks of different splits would leak rows between them and
    gets the split `purged`. Pure projection: no join, no shuffle.
    """
    if span > block:
        raise ValueError("a block must hold a whole sample")
    first = F.expr(f"start_idx div {block}")
    last = F.expr(f"(start_idx + {span - 1}) div {block}")
    a = bucket(uniform(seed, F.col(SITE), first), weights)
    b = bucket(uniform(seed, F.col(SITE), last), weights)
    return df.withColumn("split", F.when(a == b, a).otherwise("purged"))


def shuffled(df: DataFrame, seed: str, partitions: int | None = None) -> DataFrame:
    """Training order: samples dealt out and sorted by a hash, no global sort."""
    keyed = df.withColumn("order_key", uniform(seed, F.col(SITE), F.col("start_idx")))
    dealt = keyed.repartition(*([partitions] if partitions else []), "order_key")
    return dealt.sortWithinPartitions("order_key")


def sample_windows(
    df: DataFrame, n: int, seed: str, within: Sequence[str] = ("dataset",)
) -> DataFrame:
    """`n` samples per group without replacement, or all of them where there are fewer.

    The rank limit is applied before the shuffle, so a group sends at most `n` rows per task.
    """
    draw = uniform(seed, F.col(SITE), F.col("start_idx"))
    w = Window.partitionBy(*within).orderBy("draw", SITE, "start_idx")
    ranked = df.withColumn("draw", draw).withColumn("pick", F.row_number().over(w))
    return ranked.filter(F.col("pick") <= n).drop("draw")


def picked_rows(
    series: DataFrame,
    picks: DataFrame,
    lookback: int = LOOKBACK,
    horizon: int = HORIZON,
    keys: Sequence[str] = KEYS,
    at_most: int | None = None,
) -> DataFrame:
    """The rows of `series` that the picked samples (`keys`, start_idx) cover.

    Up to MAX_SENT_PICKS picks go to where the series lies, which is not moved for them; more
    of them meet it by site and row. `at_most` says how many there can be; else they are counted.
    """
    span = F.sequence(F.col("start_idx"), F.col("start_idx") + lookback + horizon - 1)
    rows = picks.select(*keys, F.explode(span).alias("row_idx")).distinct()
    return series.join(_sent(rows, picks, at_most), [*keys, "row_idx"], "left_semi")


def _sent(rows: DataFrame, picks: DataFrame, at_most: int | None) -> DataFrame:
    n = picks.limit(MAX_SENT_PICKS + 1).count() if at_most is None else at_most
    return F.broadcast(rows) if n <= MAX_SENT_PICKS else rows.hint("merge")


def with_picks(
    sample: DataFrame, picks: DataFrame, keys: Sequence[str] = KEYS, at_most: int | None = None
) -> DataFrame:
    """The samples that were picked, with the columns of `picks`."""
    return sample.join(_sent(picks, picks, at_most), [*keys, "start_idx"])


def _cuts(shares: dict[str, tuple[int, int]], total: int) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("dataset"),
                F.expr(f"n_rows * {lo} div {total}").alias("lo"),
                F.expr(f"n_rows * {hi} div {total}").alias("hi"),
            )
            for name, (lo, hi) in shares.items()
        ]
    )


def split_by_time(df: DataFrame, shares: dict[str, tuple[int, int]], total: int) -> DataFrame:
    """Cut every series into consecutive data sets; rows and lengths count from 0 in each.

    `shares` gives each data set's (from, to) out of `total` parts of the series.
    """
    rest = [c for c in df.columns if c not in ("row_idx", "n_rows")]
    cut = df.select("*", F.inline(_cuts(shares, total))).filter(
        (F.col("row_idx") >= F.col("lo")) & (F.col("row_idx") < F.col("hi"))
    )
    return cut.select(
        "dataset",
        *rest,
        (F.col("row_idx") - F.col("lo")).alias("row_idx"),
        (F.col("hi") - F.col("lo")).alias("n_rows"),
    )


def split_lengths(lengths: DataFrame, shares: dict[str, tuple[int, int]], total: int) -> DataFrame:
    """The same cut on (site, n_rows) alone."""
    cut = lengths.select(SITE, "n_rows", F.inline(_cuts(shares, total)))
    return cut.select("dataset", SITE, (F.col("hi") - F.col("lo")).alias("n_rows"))
