"""Comparing sites: every site's model on the data of other sites."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitecast.operators.chunks import attach_by_site
from sitecast.operators.metrics import r2_from
from sitecast.operators.models import regression, with_lag
from sitecast.schema import SITE, TARGET
from sitecast.sources.checkpoints import cut

# Pairs, means of x and y, and sums of squares and products about these means.
_MOMENTS = ["n", "mx", "my", "cxx", "cxy", "cyy"]


def _pair_moments(y: Column, x: Column) -> list[Column]:
    found = [F.regr_count(y, x), F.regr_avgx(y, x), F.regr_avgy(y, x)]
    found += [F.regr_sxx(y, x), F.regr_sxy(y, x), F.regr_syy(y, x)]
    return [
        F.coalesce(m.cast("double"), F.lit(0.0)).alias(name)
        for name, m in zip(_MOMENTS, found, strict=True)
    ]


def _means() -> list[Column]:
    n = F.sum("n")
    mean = [F.coalesce(F.sum(F.col("n") * F.col(m)) / F.nullif(n, F.lit(0.0)), F.lit(0.0)) for m in ("mx", "my")]
    return [n.alias("all_n"), mean[0].alias("all_mx"), mean[1].alias("all_my")]


def _about_means() -> list[Column]:
    """Sums about the pooled means: those about each part's own, and what the means differ by."""
    dx, dy = F.col("mx") - F.col("all_mx"), F.col("my") - F.col("all_my")
    moved = {"cxx": dx * dx, "cxy": dx * dy, "cyy": dy * dy}
    return [F.sum(F.col(m) + F.col("n") * d).alias(f"all_{m}") for m, d in moved.items()]


def _without(part: str) -> dict[str, Column]:
    """Moments of the whole less those of a part, both about the means of the whole."""
    n, whole = F.col(f"{part}n"), F.col("all_n")
    rest = whole - n
    share = F.coalesce(n / F.nullif(rest, F.lit(0.0)), F.lit(0.0))
    dx, dy = (F.col(f"{part}{m}") - F.col(f"all_{m}") for m in ("mx", "my"))
    # The part's means lie d away from the whole's, those of the rest -d n / rest.
    both = n + n * share
    moved = {"cxx": dx * dx, "cxy": dx * dy, "cyy": dy * dy}
    out = {f"rest_{m}": F.col(f"all_{m}") - F.col(f"{part}{m}") - both * d for m, d in moved.items()}
    return {
        "rest_n": rest,
        "rest_mx": F.col("all_mx") - dx * share,
        "rest_my": F.col("all_my") - dy * share,
        **out,
    }


def _error(prefix: str) -> tuple[Column, Column]:
    """(residual, total) sums of squares of y = a + b x."""
    n, mx, my, cxx, cxy, cyy = (F.col(prefix + m) for m in _MOMENTS)
    a, b = F.col("a"), F.col("b")
    off = my - a - b * mx
    residual = cyy - 2 * b * cxy + b * b * cxx + n * off * off
    return F.greatest(residual, F.lit(0.0)), cyy


def cross_site_scores(df: DataFrame, value: str = TARGET, scope: str = "within") -> DataFrame:
    """One-step model of each site, scored on its own data and on pooled data of others: of the
    other sites of its `city` (`within`), or of all other cities (`across`).

    The squared error of a linear model follows from six moments per site, so the moments of
    the whole less those of the site, or of its city, replace the scoring of every pair. All
    sums are about means, so series that hardly vary keep their digits.
    """
    pairs = with_lag(df.select("city", SITE, "row_idx", value), value)
    y, x = F.col(value), F.col("before")
    # A row per site, stored: several sums over the sites follow, none of them over the data.
    site = cut(pairs.groupBy("city", SITE).agg(*regression(y, x), *_pair_moments(y, x)))
    means = site.groupBy("city").agg(F.count(F.lit(1)).alias("n_sites"), *_means())
    placed = attach_by_site(site, means, key="city")
    city = placed.groupBy("city").agg(*_about_means())
    joined = attach_by_site(placed, city, key="city")
    if scope == "across":
        named = {f"all_{m}": f"city_{m}" for m in _MOMENTS}
        joined = joined.withColumnsRenamed(named)
        cities = joined.select("city", *named.values()).distinct()
        cities = cities.withColumnsRenamed({f"city_{m}": m for m in _MOMENTS})
        whole = cities.agg(*_means())
        top = whole.first().asDict()
        about = cities.withColumns({k: F.lit(v) for k, v in top.items()}).agg(*_about_means()).first().asDict()
        joined = joined.withColumns({k: F.lit(v).cast("double") for k, v in {**top, **about}.items()})
    elif scope != "within":
        raise ValueError(f"no scope {scope}")
    others = joined.withColumns(_without("city_" if scope == "across" else ""))
    own_res, own_tot = _error("")
    res, tot = _error("rest_")
    return others.select(
        "city",
        SITE,
        "n_sites",
        "a",
        "b",
        F.sqrt(own_res / F.nullif(F.col("n"), F.lit(0.0))).alias("own_rmse"),
        r2_from(F.col("n"), own_res, own_tot).alias("own_r2"),
        F.col("rest_n").cast("bigint").alias("n_cross"),
        F.sqrt(res / F.nullif(F.col("rest_n"), F.lit(0.0))).alias("cross_rmse"),
        r2_from(F.col("rest_n"), res, tot).alias("cross_r2"),
    )


def choose_sites(scores: DataFrame) -> DataFrame:
    """The site of each city whose model carries over best: R2, then error, then key."""
    w = Window.partitionBy("city").orderBy(
        F.col("cross_r2").desc_nulls_last(), F.col("cross_rmse").asc_nulls_last(), SITE
    )
    return scores.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")
