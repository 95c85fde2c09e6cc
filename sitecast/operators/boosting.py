"""Boosted regression trees from histograms, the fit of `GBTRegressor` with small blocks as its rows.

Bins, splits, leaves and weights follow `GBTRegressor` (squared error, continuous features, equal
weights), so the model is the same but for the rounding of sums. What differs is what a pass reads.
`GBTRegressor` keeps every row as an object of all its bins and goes over all of them per level.
Here rows lie in blocks of byte arrays, and a feature that stays the same over runs of neighbouring
rows (the cells of a sample share its summary) has one bin per run: moments are summed per run and
node first, and only those sums go to the bins of such a feature.

What reaches the driver is the sample for the bins (max(bins^2, 10,000) rows) and, per level, three
numbers per node, feature and bin.
"""

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Workers get these functions by value; they need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = "slow array<int>, fast array<int>, runs binary, slow_bins binary, fast_bins binary, y binary, p binary"
SUMS = "place bigint, n double, s double, q double"
ROWS_PER_BLOCK = 1 << 16
SAMPLED = 10_000
TASKS_PER_CORE = 3
EPSILON = sys.float_info.epsilon
# Gains that differ by less of the node's impurity are equal but for rounding.
TIE = 1e-10

# A tree: inner nodes by their number (children of i are 2i and 2i + 1, the root is 1) as
# (feature, last bin that goes left), and the mean of every node.
Splits = dict[int, tuple[int, int]]
Means = dict[int, float]


def boost(
    rows: DataFrame, total: int, trees: int, depth: int, bins: int, rate: float, seed: int
) -> tuple[list[tuple[Splits, Means]], list[np.ndarray]]:
    """The trees fitted on the `total` rows of `x` (array of numbers) and `y`, and the limits
    between each feature's bins.

    The first tree counts in full, each later one, grown on twice what is left, at `rate`.
    No rows, or a NULL, NaN or infinite number, are an error.
    """
    if not total:
        raise ValueError("no rows to fit trees on")
    limits = _limits(rows, total, bins, seed)
    blocks = rows.select("x", "y").mapInArrow(_packer(limits), BLOCK).persist()
    before, grown = None, []
    try:
        for k in range(trees):
            splits, means = {}, {}
            if k:
                before, blocks = blocks, blocks.mapInArrow(_adder(*grown[-1], rate if k > 1 else 1.0, depth, limits), BLOCK).persist()
            open_nodes = [1]
            for level in range(max(depth, 1)):
                if not open_nodes:
                    break
                found = _sums(blocks, _adding_up(splits, level, open_nodes, limits, k > 0), len(open_nodes), limits)
                if before is not None:
                    before.unpersist()
                    before = None
                open_nodes = [c for i, h in zip(open_nodes, found) for c in _split(i, h, limits, splits, means, depth - level)]
            grown.append((splits, means))
    finally:
        for kept in (blocks, before):
            if kept is not None:
                kept.unpersist()
    return grown, limits


def _limits(rows: DataFrame, total: int, bins: int, seed: int) -> list[np.ndarray]:
    """Limits between bins from the rows that `GBTRegressor` would draw: it samples by their places."""
    wanted = max(bins * bins, SAMPLED)
    share = wanted / total if wanted < total else 1.0
    if share < 1.0:
        spark, placed = rows.sparkSession, rows.select("x", F.monotonically_increasing_id().alias("at"))
        at = placed.select("at")._jdf
        drawn = at.toJavaRDD().sample(False, share, spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
        picks = DataFrame(spark._jsparkSession.createDataFrame(drawn, at.schema()), spark)
        rows = placed.join(F.broadcast(picks), "at", "left_semi")
    x = _matrix(rows.select("x").toArrow().column("x").combine_chunks())
    return [_feature_limits(x[:, f], share * total, min(bins, total) - 1) for f in range(x.shape[1])]


def _feature_limits(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most `most` limits of near equal weight; what the sample lacks of its expected size
    counts as zeros, as zeros are not drawn at all."""
    v, n = np.unique(values[values != 0.0], return_counts=True)
    n = n.astype(float)
    if not len(v):
        return np.empty(0)
    missing = expected - n.sum()
    if missing > EPSILON * n.sum() * 100:
        i = np.searchsorted(v, 0.0)
        v, n = np.insert(v, i, 0.0), np.insert(n, i, missing)
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride = expected / (most + 1)
    out, reached, target = [], n[0], stride
    for i in range(1, len(v)):
        earlier, reached = reached, reached + n[i]
        if abs(earlier - target) < abs(reached - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _matrix(column) -> np.ndarray:
    n, flat = len(column), column.flatten()
    if not n:
        return np.empty((0, 0))
    x = flat.to_numpy(zero_copy_only=False).reshape(n, -1)
    if column.null_count or np.ptp(np.diff(column.offsets.to_numpy())) or not np.isfinite(x).all():
        raise ValueError("a feature is NULL, NaN or infinite, or rows differ in length")
    return x


def _small(limits: list[np.ndarray]) -> type:
    """What holds any bin."""
    return np.uint8 if max(map(len, limits)) < 256 else np.uint16 if max(map(len, limits)) < 1 << 16 else np.uint32


def _packer(limits: list[np.ndarray]):
    """Rows to blocks: bins of each feature per run or per row, targets, and predictions of 0."""
    small = _small(limits)

    def packed(x: np.ndarray) -> tuple:
        x = np.ascontiguousarray(x.T)
        changes = x[:, 1:] != x[:, :-1]
        calm = np.count_nonzero(changes, axis=1) * 4 <= x.shape[1]
        slow, fast = np.flatnonzero(calm), np.flatnonzero(~calm)
        begins = np.ones(x.shape[1], bool)
        begins[1:] = np.logical_or.reduce(changes[slow], axis=0)
        starts = np.flatnonzero(begins)
        runs = np.diff(np.append(starts, x.shape[1])).astype(np.int32)

        def binned(features, at):
            out = [np.searchsorted(limits[f], x[f, at]).astype(small) for f in features]
            return np.array(out, small).reshape(len(features), len(at))

        return slow, fast, runs, binned(slow, starts), binned(fast, np.arange(x.shape[1]))

    def block(parts: list[tuple], y: list[np.ndarray]) -> pa.RecordBatch:
        y = np.concatenate(y)
        slow, fast = parts[0][:2]
        joined = [np.concatenate([part[i] for part in parts], axis=-1) for i in (2, 3, 4)]
        cells = [pa.array([[*map(int, f)]], pa.list_(pa.int32())) for f in (slow, fast)]
        cells += [pa.array([a.tobytes()], pa.binary()) for a in (*joined, y, np.zeros(len(y)))]
        return pa.RecordBatch.from_arrays(cells, names=["slow", "fast", "runs", "slow_bins", "fast_bins", "y", "p"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ys, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, y = packed(_matrix(batch.column("x"))), batch.column("y").to_numpy(zero_copy_only=False)
            if not np.isfinite(y).all():
                raise ValueError("a target is NULL, NaN or infinite")
            if parts and (n >= ROWS_PER_BLOCK or not np.array_equal(part[0], parts[0][0])):
                yield block(parts, ys)
                parts, ys, n = [], [], 0
            parts.append(part)
            ys.append(y)
            n += len(y)
        if parts:
            yield block(parts, ys)

    return pack


class _Block:
    """A block read back."""

    def __init__(self, row: dict, small: type):
        self.y, self.p = np.frombuffer(row["y"]), np.frombuffer(row["p"])
        self.runs = np.frombuffer(row["runs"], np.int32)
        slow = np.frombuffer(row["slow_bins"], small).reshape(-1, len(self.runs))
        fast = np.frombuffer(row["fast_bins"], small).reshape(-1, len(self.y))
        self.slow, self.fast = dict(zip(row["slow"], slow)), dict(zip(row["fast"], fast))

    def each(self, of_runs: np.ndarray) -> np.ndarray:
        return np.repeat(of_runs, self.runs)

    def nodes(self, splits: Splits, depth: int) -> tuple[np.ndarray, bool]:
        """The node of every row, or of every run, where all of a run's rows are in one (True)."""
        by_run = all(f in self.slow for f, _ in splits.values())
        at = np.ones(len(self.runs if by_run else self.y), np.min_scalar_type(2 << depth))
        for i in sorted(splits):
            f, last = splits[i]
            right = (self.slow[f] if f in self.slow else self.fast[f]) > last
            if f in self.slow and not by_run:
                right = self.each(right)
            at = np.where(at == i, (right + at.dtype.type(2 * i)).astype(at.dtype), at)
        return at, by_run


def _blocks(batches: Iterator[pa.RecordBatch], small: type) -> Iterator[tuple[pa.RecordBatch, _Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.slice(i, 1)
            yield part, _Block(part.to_pylist()[0], small)


def _adder(splits: Splits, means: Means, weight: float, depth: int, limits: list[np.ndarray]):
    """Adds what a tree predicts to the predictions of blocks, and leaves the rest as it is."""
    small = _small(limits)
    values = np.zeros(2 << depth)
    for i, mean in means.items():
        values[i] = weight * mean

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block in _blocks(batches, small):
            at, by_run = block.nodes(splits, depth)
            more = block.each(values[at]) if by_run else values[at]
            p = pa.array([(block.p + more).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], p], names=part.schema.names)

    return add


def _adding_up(splits: Splits, level: int, nodes: list[int], limits: list[np.ndarray], later: bool):
    """Sums of 1, target and its square per node of the level, feature and bin, once a task.

    The target is `y`, and in a `later` tree twice what the predictions leave of it.
    """
    width, k = max(map(len, limits)) + 1, len(nodes)
    small = _small(limits)
    # Rows that have come to rest in a leaf above go to a place of their own, which is dropped.
    number = np.full(2 << level, k)
    number[nodes] = range(k)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, len(limits), (k + 1) * width))

        def count(f, at, bins, n, s, q):
            place = at * width + bins
            for i, weights in enumerate((n, s, q)):
                sums[i, f] += np.bincount(place, weights, minlength=(k + 1) * width)

        for _, block in _blocks(batches, small):
            r = 2.0 * (block.y - block.p) if later else block.y
            square = r * r
            at, by_run = block.nodes(splits, level)
            at = number[at]
            if by_run:
                starts = np.cumsum(block.runs) - block.runs
                moments = block.runs.astype(float), np.add.reduceat(r, starts), np.add.reduceat(square, starts)
                pair, of_run = None, at
                at = block.each(at) if block.fast else at
            else:
                place = block.each(np.arange(len(block.runs)) * (k + 1)) + at
                some = [np.bincount(place, w, minlength=len(block.runs) * (k + 1)) for w in (None, r, square)]
                pair = np.flatnonzero(some[0])
                moments = tuple(m[pair].astype(float) for m in some)
                pair, of_run = np.divmod(pair, k + 1)
            for f, bins in block.slow.items():
                count(f, of_run, bins if pair is None else bins[pair], *moments)
            for f, bins in block.fast.items():
                count(f, at, bins, None, r, square)
        kept = sums.reshape(3, len(limits), k + 1, width)[:, :, :k].transpose(0, 2, 1, 3).reshape(3, -1)
        place = np.flatnonzero(kept[0])
        yield pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(m[place]) for m in kept]], names=["place", "n", "s", "q"])

    return add_up


def _sums(blocks: DataFrame, add_up, nodes: int, limits: list[np.ndarray]) -> np.ndarray:
    """The sums of all tasks, by node, feature, bin and moment."""
    tasks = TASKS_PER_CORE * blocks.sparkSession.sparkContext.defaultParallelism
    parts = blocks.coalesce(tasks).mapInArrow(add_up, SUMS)
    rows = parts.groupBy("place").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]).toArrow()
    out = np.zeros((nodes * len(limits) * (max(map(len, limits)) + 1), 3))
    out[rows.column("place").to_numpy()] = np.column_stack([rows.column(c).to_numpy() for c in ("n", "s", "q")])
    return out.reshape(nodes, len(limits), -1, 3)


def _impurity(m: np.ndarray) -> np.ndarray:
    n = np.where(m[..., 0] > 0, m[..., 0], 1.0)
    return np.where(m[..., 0] > 0, (m[..., 2] - m[..., 1] * m[..., 1] / n) / n, 0.0)


def _split(i: int, sums: np.ndarray, limits: list[np.ndarray], splits: Splits, means: Means, levels: int) -> list[int]:
    """Splits node `i`, which may have `levels` below it, where that gains most, and gives the
    children that may be split in turn. A node that gains nothing is a leaf. The first of equal
    splits is taken; `GBTRegressor` leaves that to the rounding of its sums."""
    left = np.cumsum(sums, axis=1)
    all_of = left[:, -1:, :]
    total, right = all_of[0, 0], all_of - left
    means[i] = total[1] / total[0]
    if not levels:
        return []
    gain = _impurity(all_of) - left[..., 0] / total[0] * _impurity(left) - right[..., 0] / total[0] * _impurity(right)
    real = np.arange(sums.shape[1]) < np.array([len(v) for v in limits])[:, None]
    gain = np.where(real & (left[..., 0] >= 1) & (right[..., 0] >= 1), gain, -math.inf)
    f, b = np.unravel_index(np.argmax(gain >= gain.max() - TIE * _impurity(total)), gain.shape)
    if not gain[f, b] > 0:
        return []
    splits[i] = int(f), int(b)
    sides = {2 * i: left[f, b], 2 * i + 1: right[f, b]}
    for child, m in sides.items():
        means[child] = m[1] / m[0]
    return [] if levels == 1 else [c for c, m in sides.items() if abs(_impurity(m)) >= EPSILON]
