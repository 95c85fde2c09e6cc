"""Repeatable uniform draws from row keys (no partition-dependent randomness)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: str, *keys: Column) -> Column:
    """A double in [0, 1) that depends on the seed and the key values only."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(
        4294967296.0
    )


def bucket(u: Column, weights: dict[str, float]) -> Column:
    """Name of the weight band that a uniform draw falls into."""
    total = sum(weights.values())
    names = list(weights)
    edge, out = 0.0, None
    for name in names[:-1]:
        edge += weights[name] / total
        cond = u < F.lit(edge)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
