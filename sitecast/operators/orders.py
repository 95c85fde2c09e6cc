"""A shuffled order of samples for every epoch, computed from the sample's number alone.

Two levels: blocks of neighbouring samples are permuted, and the samples inside each block. A
loader that reads block by block keeps its reads local, and nothing is sorted or moved. The last
block, where it is short, keeps its place, so positions have no gaps.

A permutation of any size n is made of Feistel networks over the largest power of two h <= n:
one over the first h numbers, one over the last h (more than half, so they overlap), and one over
the first h again. Every round changes one half of the bits by a hash of the other half, so the
same rounds backwards find the sample at a position.
"""

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
PASSES, ROUNDS = 3, 4
PRIME = (1 << 31) - 1  # products of two values below it stay within 64 bits

Round = tuple[int, int, int]


def round_keys(seed: str, epoch: int, level: str) -> list[list[Round]]:
    """Three numbers below PRIME for every round of every pass."""

    def numbers(text: str) -> Round:
        digest = hashlib.sha256(text.encode()).digest()
        return tuple(1 + int.from_bytes(digest[4 * j : 4 * j + 4], "big") % (PRIME - 1) for j in range(3))

    return [[numbers(f"{seed}:{epoch}:{level}:{p}:{r}") for r in range(ROUNDS)] for p in range(PASSES)]


def halves(n: int) -> tuple[int, int]:
    """The largest power of two up to n, and the part of it that the lower half of its bits spans."""
    bits = max(n, 1).bit_length() - 1
    return 1 << bits, 1 << ((bits + 1) // 2)


def _permuted(df: DataFrame, x: str, size: Column, h: Column, low: Column, of: str, keys: list, back: bool) -> DataFrame:
    """Replaces the numbers of column `x`, below `size`, by those of the permutation that the
    block number `of` selects. A column per round keeps every expression small."""
    df = df.withColumns({"_h": h, "_low": low, "_size": size})
    for p in reversed(range(PASSES)) if back else range(PASSES):
        start = F.col("_size") - F.col("_h") if p % 2 else F.lit(0).cast("bigint")
        df = df.withColumn("_from", start)
        y = F.col(x) - F.col("_from")
        df = df.withColumns({"_in": (y >= 0) & (y < F.col("_h")), "_y": F.greatest(y, F.lit(0))})
        df = df.withColumns({"_a": F.expr("_y div _low"), "_b": F.col("_y") % F.col("_low")})
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            m, a, c = keys[p][r]
            half, other, mask = ("_a", "_b", F.expr("_h div _low") - 1) if r % 2 == 0 else ("_b", "_a", F.col("_low") - 1)
            mixed = (F.col(other) + F.col(of) % PRIME * m % PRIME) % PRIME * a % PRIME
            mixed = ((mixed + c) % PRIME) * ((mixed + c) % PRIME) % PRIME
            df = df.withColumn(half, F.col(half).bitwiseXOR(F.shiftright(mixed, 9).bitwiseAND(mask)))
        moved = F.col("_from") + F.col("_a") * F.col("_low") + F.col("_b")
        df = df.withColumn(x, F.when(F.col("_in"), moved).otherwise(F.col(x)))
    return df.drop("_h", "_low", "_size", "_from", "_in", "_y", "_a", "_b")


class EpochOrder:
    """The order of samples 0..total-1 in one epoch; other epochs and seeds give other orders."""

    def __init__(self, total: int, seed: str, epoch: int, block: int = BLOCK):
        if block < 1 or block >= PRIME or total // block >= PRIME:
            raise ValueError("too many blocks, or a block out of range")
        self.block, self.full, self.tail = block, total // block, total % block
        self.outer, self.inner = (round_keys(seed, epoch, level) for level in ("blocks", "inside"))

    def _placed(self, df: DataFrame, number: str, name: str, back: bool) -> DataFrame:
        long, whole = (lambda v: F.lit(v).cast("bigint")), F.col("_block") < self.full
        kept = [F.col(f"`{c}`") for c in df.columns if c != name]
        df = df.withColumn("_block", F.floor(F.col(number) / self.block).cast("bigint"))
        df = df.withColumns({"_inside": F.col(number) - F.col("_block") * self.block, "_whole": whole, "_zero": long(0)})
        # A short last block stays in place: it is sent through as block 0 and taken back after.
        df = df.withColumns({"_own": F.col("_block"), "_moved": F.when(F.col("_whole"), F.col("_block")).otherwise(long(0))})
        h, low = halves(self.full)
        df = _permuted(df, "_moved", long(max(self.full, 1)), long(h), long(low), "_zero", self.outer, back)
        df = df.withColumn("_moved", F.when(F.col("_whole"), F.col("_moved")).otherwise(F.col("_own")))
        big, short = halves(self.block), halves(self.tail)

        def either(a: int, b: int) -> Column:
            return F.when(F.col("_whole"), long(a)).otherwise(long(b))

        sizes = either(self.block, max(self.tail, 1)), either(big[0], short[0]), either(big[1], short[1])
        df = _permuted(df, "_inside", *sizes, "_moved" if back else "_own", self.inner, back)
        return df.select(*kept, (F.col("_moved") * self.block + F.col("_inside")).alias(name))

    def with_position(self, df: DataFrame, sample_id: str = "sample_id", name: str = "position") -> DataFrame:
        """Adds the place of the sample in the epoch, from 0 (NULL for a NULL number)."""
        return self._placed(df, sample_id, name, back=False)

    def with_sample(self, df: DataFrame, position: str = "position", name: str = "sample_id") -> DataFrame:
        """Adds the sample that comes at the place: the inverse of `with_position`."""
        return self._placed(df, position, name, back=True)
