"""Sharding by best-fit decreasing with a balanced tree of remaining capacities.

Groups of rows stay together. Groups smaller than a bundle (a small fixed part of a shard) are
first packed into bundles, in as many tasks as there are blocks of groups; where the blocks are
many, what is left half empty is packed again, until few blocks are left. Bundles and larger
groups, a number that depends on the number of shards and not on the rows, are then packed into
shards. All levels are best-fit decreasing: falling size, tightest bin that still fits.
"""

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import bytes_of, cut, numbered, ship

SHARDS, BUNDLES_PER_SHARD = 16, 512
# Groups of a block: this many at most, and fewer while that makes less than MIN_BLOCKS tasks.
BLOCK_GROUPS, FEWER_GROUPS, MIN_BLOCKS = 50_000, 500, 64
# Blocks whose bundles the driver takes as they are; those of more blocks are packed again.
MOST_BLOCKS = 4096
NODE = 256


class CapacityTree:
    """Sorted (remaining capacity, bin) pairs in a B-tree of two levels: nodes split in the
    middle when they are full, so an insert, a removal and a search move at most a node."""

    def __init__(self) -> None:
        self.nodes: list[list[tuple[int, int]]] = []
        self.least: list[tuple[int, int]] = []

    def add(self, item: tuple[int, int]) -> None:
        if not self.nodes:
            self.nodes, self.least = [[item]], [item]
            return
        at = max(bisect_left(self.least, item) - 1, 0)
        node = self.nodes[at]
        insort(node, item)
        self.least[at] = node[0]
        if len(node) > NODE:
            half = node[NODE // 2 :]
            del node[NODE // 2 :]
            self.nodes.insert(at + 1, half)
            self.least.insert(at + 1, half[0])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity that is `size` at least."""
        wanted = (size, -1)
        at = max(bisect_left(self.least, wanted) - 1, 0)
        for i in (at, at + 1):
            if i < len(self.nodes):
                node = self.nodes[i]
                place = bisect_left(node, wanted)
                if place < len(node):
                    item = node.pop(place)
                    if node:
                        self.least[i] = node[0]
                    else:
                        del self.nodes[i], self.least[i]
                    return item
        return None


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of every size and the number of bins; a size over the capacity gets its own bin."""
    bins = np.zeros(len(sizes), dtype=np.int64)
    tree, used = CapacityTree(), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take_tightest(size)
        room, number = found if found else (capacity, used)
        used += found is None
        bins[i] = number
        if room > size:
            tree.add((room - size, number))
    return bins, used


def near_equal(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item: best-fit decreasing with the least capacity that needs no more than
    `shards` bins, found by bisection. Items larger than an equal share of what is left keep a
    shard to themselves, so they don't widen the others."""
    out = np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    left, alone = int(sizes.sum()), 0
    while alone < min(shards - 1, len(order)) and sizes[order[alone]] * (shards - alone) > left:
        left -= int(sizes[order[alone]])
        out[order[alone]] = alone
        alone += 1
    rest = order[alone:]
    if not len(rest):
        return out
    low = max(-(-left // (shards - alone)), int(sizes[rest].max()))
    high, best = 2 * low, None
    while best is None or low < high:
        middle = (low + high) // 2 if best is not None else high
        bins, used = best_fit_decreasing(sizes[rest], middle)
        if used <= shards - alone:
            best, high = bins, middle
        elif best is None:
            low, high = high, 2 * high
        else:
            low = middle + 1
    out[rest] = alone + best
    return out


def _blocks(groups: int) -> int:
    return max(1, -(-groups // BLOCK_GROUPS), min(MIN_BLOCKS, groups // FEWER_GROUPS))


def _packed(small: DataFrame, capacity: int, blocks: int, first: int) -> DataFrame:
    """Small groups with `block`, numbered from `first`, and `bin`: best-fit decreasing within
    blocks of groups, one task each."""
    ship(small.sparkSession)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key")
        bins, _ = best_fit_decreasing(frame["bytes"].to_numpy(), capacity)
        return pd.DataFrame({"key": frame["key"], "bytes": frame["bytes"], "block": frame["block"], "bin": bins})

    block = F.lit(first) + F.pmod(F.xxhash64("key"), F.lit(blocks))
    blocked = small.select("key", "bytes", block.alias("block"))
    return blocked.groupBy("block").applyInPandas(pack, "key binary, bytes long, block long, bin long")


def bundled(small: DataFrame, capacity: int, groups: int) -> DataFrame:
    """(key, bytes, block, bin), stored: the bundle (block, bin) of each of at most `groups` groups.

    Of the bundles of a block at most one is less than half full, so there are at most
    2 * bytes / capacity + MOST_BLOCKS bundles: beyond MOST_BLOCKS blocks the half empty ones, as
    many as blocks, are groups to pack again.
    """
    first, blocks = 0, _blocks(groups)
    packed = cut(_packed(small, capacity, blocks, first))
    name = F.unhex(F.format_string("%016x%016x", "block", "bin"))
    while blocks > MOST_BLOCKS:
        bundles = packed.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes"))
        light = bundles.filter(F.col("bytes") * 2 < capacity).select(name.alias("key"), "bytes")
        first, blocks = first + blocks, _blocks(blocks)
        again = _packed(light, capacity, blocks, first).select(
            F.col("key").alias("_name"), F.col("block").alias("_block"), F.col("bin").alias("_bin")
        )
        moved = packed.withColumn("_name", name).join(again, "_name", "left")
        place = (F.coalesce("_block", "block").alias("block"), F.coalesce("_bin", "bin").alias("bin"))
        packed = cut(moved.select("key", "bytes", *place))
    return packed


def assign_groups(groups: DataFrame, shards: int = SHARDS, per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """(key, shard, large) for `groups` (key binary, bytes long): shards of nearly equal size.

    At most shards * per_shard groups reach the size of a bundle (`large`), and there are about
    2 * shards * per_shard + MOST_BLOCKS bundles at most. So the driver packs a number of items
    that the parameters bound. No groups give no rows.
    """
    groups = cut(groups.select("key", "bytes"))
    row = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("total")).first()
    capacity = max((row["total"] or 0) // (shards * per_shard), 1)
    packed = bundled(groups.filter(F.col("bytes") < capacity), capacity, row["n"])
    bundles = packed.groupBy("block", "bin").agg(F.sum("bytes").alias("bytes"))
    small = [(r["block"], r["bin"], r["bytes"]) for r in bundles.orderBy("block", "bin").collect()]
    large = groups.filter(F.col("bytes") >= capacity).orderBy("key").collect()
    sizes = np.array([b[2] for b in small] + [r["bytes"] for r in large], dtype=np.int64)
    shard = near_equal(sizes, shards).tolist()
    spark = groups.sparkSession
    of_bundle = spark.createDataFrame(
        [(b, i, s) for (b, i, _), s in zip(small, shard, strict=False)], "block long, bin long, shard int"
    )
    of_large = spark.createDataFrame(
        [(bytes(r["key"]), s) for r, s in zip(large, shard[len(small) :], strict=True)],
        "key binary, shard int",
    )
    of_small = packed.join(of_bundle, ["block", "bin"]).select("key", "shard")
    return of_large.withColumn("large", F.lit(True)).unionByName(of_small.withColumn("large", F.lit(False)))


def text_group(text: Column) -> Column:
    """Key of a group of equal texts; NULL is a group apart from the empty text."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("00")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, shard, slot; equal texts share a shard.

    size is the UTF-8 bytes plus 1; a NULL text has no bytes and the crc32 of none. Slots are
    gapless from 0 in each shard. Repeated rows get slots of their own; other columns are left
    out; an empty table gives an empty one. The texts are read once: what is stored and joined
    are keys of 32 bytes. Large groups, bounded in number, are looked up apart from the small
    ones, none of which has more rows than a bundle has bytes.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (bytes_of(F.col(text)) + 1).alias("size"),
            F.crc32(content.cast("binary")).alias("text_crc32"),
            text_group(F.col(text)).alias("key"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    places = cut(assign_groups(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards))
    large = places.filter("large").select("key", F.col("shard").alias("_large"))
    small = places.filter("not large").select("key", F.col("shard").alias("_small"))
    first = rows.join(F.broadcast(large), "key", "left")
    hot = first.filter(F.col("_large").isNotNull()).withColumn("shard", F.col("_large")).drop("_large")
    cool = first.filter(F.col("_large").isNull()).drop("_large").join(small, "key")
    cool = cool.withColumn("shard", F.col("_small")).drop("_small")
    placed = cut(hot.unionByName(cool).drop("key"))
    return numbered(placed, "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
