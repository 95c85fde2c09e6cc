"""Connected components of links between longs, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its smallest one (itself included)."""
    both = _both(links)
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.filter("v > u").join(lowest, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = lowest.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).filter("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), total).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (u, v): root is the smallest node of its component.

    Large-star and small-star rounds, until nothing changes; each round is stored, so a lost
    executor costs one round. Minima are partial sums and hubs are joined with skew splitting;
    the driver sees a count and a checksum per round. Loops and repeated links are allowed.
    """
    now = cut(links.filter("u != v").distinct())
    before = _state(now)
    while before[0]:
        now = cut(_small_star(_large_star(now)))
        after = _state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
