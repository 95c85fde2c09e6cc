"""Windows over long series without one task per site.

A site's rows are cut into chunks of `width` consecutive rows and windows run per
(site, chunk). Frames of bounded reach get the missing margin as copied rows (`with_halo`);
frames that look back without bound get one carried value per chunk (`running`).
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sitecast.schema import CHUNK, SITE

KEYS = (SITE,)


def with_halo(df: DataFrame, before: int = 0, after: int = 0, width: int = CHUNK) -> DataFrame:
    """Add `chunk_id`, copying each row into the neighbouring chunks whose frames reach it."""
    if max(before, after) > width:
        raise ValueError("a frame must not reach further than one chunk")
    place = F.pmod("row_idx", F.lit(width))
    own = F.expr(f"row_idx div {width}")
    first = own - F.when((place < after) & (own > 0), 1).otherwise(0) if after else own
    last = own + F.when(place >= width - before, 1).otherwise(0) if before else own
    return df.withColumn("chunk_id", F.explode(F.sequence(first, last)))


def chunk_window(keys: Sequence[str] = KEYS) -> WindowSpec:
    return Window.partitionBy(*keys, "chunk_id").orderBy("row_idx")


def drop_halo(df: DataFrame, width: int = CHUNK) -> DataFrame:
    """Keep the rows that belong to their chunk; the copies have served the frames."""
    return df.filter(F.col("chunk_id") == F.expr(f"row_idx div {width}")).drop("chunk_id")


# How a running value starts inside a chunk, and how it joins what came before the chunk.
_FOLD = {
    "last": (
        lambda c, idx: F.last(c, ignorenulls=True),
        lambda c, idx: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx))),
        lambda here, before: F.coalesce(here, before),
    ),
    "min": (  # also of structs, which order by their first field
        lambda c, idx: F.min(c),
        lambda c, idx: F.min(c),
        lambda here, before: F.least(here, before),
    ),
    "max": (
        lambda c, idx: F.max(c),
        lambda c, idx: F.max(c),
        lambda here, before: F.greatest(here, before),
    ),
    "sum": (
        lambda c, idx: F.sum(c),
        lambda c, idx: F.sum(c),
        lambda here, before: F.coalesce(here + before, here, before),
    ),
}


def running(
    df: DataFrame,
    folds: dict[str, tuple[str, str]],
    keys: Sequence[str] = KEYS,
    idx: str = "row_idx",
    inclusive: bool = True,
    width: int = CHUNK,
    levels: int = 1,
    carriers: DataFrame | None = None,
) -> DataFrame:
    """Running `last` / `min` / `max` / `sum` from the start of each series.

    `folds` maps a new column to (column, kind). Chunks are folded first, then the chunk
    totals (one row each) are folded the same way, so no task ever holds a whole series:
    the last level orders rows / width**levels of them. Where only some rows carry values,
    those may be given as `carriers` to fold the chunk totals from them alone.
    """
    end = Window.currentRow if inclusive else -1
    frame = Window.partitionBy(*keys)
    if levels == 0:
        w = frame.orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({n: _FOLD[k][0](c, idx).over(w) for n, (c, k) in folds.items()})

    block = f"{idx}_block"
    cut = df.withColumn(block, F.floor(F.col(idx) / width).cast("bigint"))
    w = Window.partitionBy(*keys, block).orderBy(idx).rowsBetween(Window.unboundedPreceding, end)
    here = cut.withColumns({n: _FOLD[k][0](c, idx).over(w) for n, (c, k) in folds.items()})
    if carriers is not None:
        carriers = carriers.withColumn(block, F.floor(F.col(idx) / width).cast("bigint"))
    totals = (cut if carriers is None else carriers).groupBy(*keys, block).agg(
        *[_FOLD[k][1](c, idx).alias(f"{n}_total") for n, (c, k) in folds.items()]
    )
    before = running(
        totals,
        {f"{n}_before": (f"{n}_total", k) for n, (_, k) in folds.items()},
        keys,
        block,
        inclusive=False,
        width=width,
        levels=levels - 1,
    ).select(*keys, block, *[f"{n}_before" for n in folds])
    # The rows already lie by (site, chunk) in order, so a merge moves only the totals.
    joined = here.join(before.hint("merge"), [*keys, block], "left")
    joined = joined.withColumns(
        {n: _FOLD[k][2](F.col(n), F.col(f"{n}_before")) for n, (_, k) in folds.items()}
    )
    return joined.select(*df.columns, *folds)


def attach_by_site(df: DataFrame, sites: DataFrame, how: str = "inner", key: str = SITE) -> DataFrame:
    """Look up one row per site, keys compared as text; `inner` drops unknown sites.

    Spark broadcasts the site table when its size allows and otherwise shuffles, splitting
    the partition of a site that holds much of the data (adaptive skew join). The join stays
    an outer one, with the drop done afterwards: only the right side of an outer join may be
    broadcast, so the readings, whose unfolded size Spark cannot foresee, never are.
    """
    left = df.withColumn("site_text", F.col(key).cast("string"))
    columns = [c for c in sites.columns if c != key]
    right = sites.select(F.col(key).cast("string").alias("site_text"), *columns, F.lit(True).alias("found"))
    joined = left.join(right, "site_text", "left")
    if how == "inner":
        # Names a left column too, or the optimizer would turn the join back into an inner one.
        joined = joined.filter(F.coalesce(F.col("found"), F.length("site_text") < 0))
    return joined.drop("site_text", "found")


def attach_by_chunk(df: DataFrame, sites: DataFrame, width: int = CHUNK) -> DataFrame:
    """Look up one row per site (with the site's `n_rows`) beside rows with `row_idx`; rows of
    unknown sites drop out.

    The lookup has one row per chunk of a site, a thousandth of the data, so a site with a third
    of all rows is joined by as many tasks as it has chunks, whatever size Spark may broadcast.
    As in `attach_by_site`, only the lookup may be the broadcast side.
    """
    last = F.expr(f"(n_rows - 1) div {width}")
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_id")
    columns = [c for c in sites.columns if c not in (SITE, "n_rows")]
    right = sites.filter("n_rows > 0").select(SITE, chunk, *columns, F.lit(True).alias("found"))
    left = df.withColumn("chunk_id", F.expr(f"row_idx div {width}"))
    joined = left.join(right, [SITE, "chunk_id"], "left")
    # Names a left column too, or the optimizer would turn the join back into an inner one.
    joined = joined.filter(F.coalesce(F.col("found"), F.col("chunk_id") < 0))
    return joined.select(*df.columns, *columns)
