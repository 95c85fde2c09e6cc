"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents may be long, so the Jaccard similarity of the two says
little. Items are partitioned by size into classes of powers of two; for each class every
document is seen through overlapping windows that fit the class, so an item lies whole in some
window with a similarity of at least 0.8 / 2.7. A window and an item that share a MinHash under
any of the functions are a candidate, verified by exact containment of the item's shingles in
the whole document. Windows hold 20 shingles or more, so items of fewer than eight shingles would
be too small a part of one: any of their shingles makes a candidate, which misses none. Of the
others, planted whole, less than one in 10^9 is missed.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitecast.llm.common import ship, stored
from sitecast.llm.shingles import shingle_hashes

WIDTH, THRESHOLD, FUNCTIONS, SEED = 5, 0.8, 64, 11
# Shingles of the items that one pass over the documents compares; more items take more passes.
SHINGLES_PER_PASS = 1 << 20
MIN_LEVEL = 2
# Items of fewer shingles are looked up by their shingles.
SHORT = 8
FILTER_BITS = 22
BATCH_SHINGLES = 1 << 17
FOUND = "item_id {key}, n_shared long, n_item long, containment double"


def _multipliers(functions: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, size=functions, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _halves(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)


def _halved(n: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For documents of `n` blocks: how many of twice the length, and the two blocks of each."""
    half = -(-n // 2)
    owner = np.repeat(np.arange(len(n)), half)
    start = (np.cumsum(n) - n)[owner]
    left = 2 * (np.arange(len(owner)) - (np.cumsum(half) - half)[owner])
    return half, (start + left, start + np.minimum(left + 1, n[owner] - 1))


def _windows(n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document of every block, and the blocks one, two and four further on, or its last: the
    least of five blocks is that of two pairs and the fifth."""
    owner = np.repeat(np.arange(len(n)), n)
    last = (np.cumsum(n) - 1)[owner]
    at = np.arange(len(owner))
    return owner, np.minimum(at + 1, last), np.minimum(at + 2, last), np.minimum(at + 4, last)


class ItemIndex:
    """MinHashes of a bounded block of items, by size class, and their shingles."""

    def __init__(self, items: list[tuple], width: int, functions: int, seed: int):
        self.width = width
        self.multipliers = _multipliers(functions, seed)
        self.ids, self.sets = [], []
        by_level: dict[int, list[tuple[int, np.ndarray]]] = {}
        short: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            hashes = shingle_hashes(text, width)
            if not len(hashes):
                continue
            if len(hashes) < SHORT:
                short.append((len(self.ids), np.unique(hashes)))
                self.ids.append(item_id)
                self.sets.append(short[-1][1])
                continue
            # A class holds n in 2^c .. 2^(c+1) - 1; its blocks have 2^(c-1) shingles.
            level = max(len(hashes).bit_length() - 2, MIN_LEVEL)
            by_level.setdefault(level, []).append((len(self.ids), hashes))
            self.ids.append(item_id)
            self.sets.append(np.unique(hashes))
        empty = np.array([], np.uint64)
        keys = np.concatenate([empty, *[x for _, x in short]])
        at = np.repeat([i for i, _ in short], [len(x) for _, x in short]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        self.short_keys, self.short_items = keys[order], at[order]
        self.levels = {}
        for level, members in sorted(by_level.items()):
            lists = [np.array([m[0] for m in members], dtype=np.int64)] * functions
            values = [
                np.array([self._hashed(m[1], f).min() for m in members], dtype=np.uint32)
                for f in range(functions)
            ]
            known = np.zeros(1 << FILTER_BITS, dtype=bool)
            for v in values:
                known[v >> np.uint32(32 - FILTER_BITS)] = True
            order = [np.argsort(v, kind="stable") for v in values]
            self.levels[level] = (
                known,
                [v[o] for v, o in zip(values, order, strict=True)],
                [i[o] for i, o in zip(lists, order, strict=True)],
            )

    def _hashed(self, shingles: np.ndarray, function: int) -> np.ndarray:
        """32 bits per shingle: its low half times an odd number, mixed with its high half."""
        return self._mixed(*_halves(shingles), function)

    def _mixed(self, low: np.ndarray, high: np.ndarray, function: int) -> np.ndarray:
        return (low * self.multipliers[function]) ^ high

    def candidates(self, docs: list[np.ndarray]) -> set[tuple[int, int]]:
        """(place of the document, place of the item) of windows that share a MinHash."""
        docs_at = [i for i, d in enumerate(docs) if len(d)]
        if not docs_at:
            return set()
        sizes = np.array([len(docs[i]) for i in docs_at], dtype=np.int64)
        flat = np.concatenate([docs[i] for i in docs_at])
        found = self._short(flat, np.repeat(docs_at, sizes))
        if not self.levels:
            return found
        base, top = min(self.levels), max(self.levels)
        # Documents become whole blocks; the last shingle fills the last block up.
        blocks = -(-sizes // (1 << base))
        owner = np.repeat(np.arange(len(sizes)), blocks << base)
        first = np.cumsum(blocks << base) - (blocks << base)
        place = np.arange(len(owner)) - first[owner]
        low, high = _halves(flat[np.minimum(place, sizes[owner] - 1) + (np.cumsum(sizes) - sizes)[owner]])
        # Where the blocks of each level lie is the same for all functions.
        steps, n = [], blocks
        for level in range(base, top + 1):
            halves = None
            if level > base:
                n, halves = _halved(n)
            steps.append((level, halves, _windows(n) if level in self.levels else None))
        for f in range(len(self.multipliers)):
            least = self._mixed(low, high, f)
            for _ in range(base):
                least = np.minimum(least[::2], least[1::2])
            for level, halves, windows in steps:
                if halves:
                    least = np.minimum(least[halves[0]], least[halves[1]])
                if windows:
                    found |= self._matches(level, f, windows, least, docs_at)
        return found

    def _short(self, shingles: np.ndarray, doc_of: np.ndarray) -> set[tuple[int, int]]:
        """(document, short item) pairs that share a shingle."""
        if not len(self.short_keys):
            return set()
        start = np.searchsorted(self.short_keys, shingles, "left")
        hits = np.flatnonzero(self.short_keys[np.minimum(start, len(self.short_keys) - 1)] == shingles)
        pairs = set()
        for i in hits:
            end = np.searchsorted(self.short_keys, shingles[i], "right")
            pairs.update((int(doc_of[i]), int(j)) for j in self.short_items[start[i] : end])
        return pairs

    def _matches(
        self, level: int, f: int, windows: tuple[np.ndarray, ...], least: np.ndarray, docs_at: list[int]
    ) -> set[tuple[int, int]]:
        owner, one, two, four = windows
        pair = np.minimum(least, least[one])
        window = np.minimum(np.minimum(pair, pair[two]), least[four])
        known, values, items = self.levels[level]
        maybe = np.flatnonzero(known[window >> np.uint32(32 - FILTER_BITS)])
        if not len(maybe):
            return set()
        start = np.searchsorted(values[f], window[maybe], "left")
        end = np.searchsorted(values[f], window[maybe], "right")
        pairs = set()
        for i in np.flatnonzero(end > start):
            doc = docs_at[owner[maybe[i]]]
            pairs.update((doc, int(j)) for j in items[f][start[i] : end[i]])
        return pairs

    def contained(self, texts: list[str | None], threshold: float) -> Iterator[tuple]:
        """(place of the text, item id, shared, shingles of the item), in order of the texts."""
        docs: list[np.ndarray] = []
        start, held = 0, 0
        for at, text in enumerate(texts):
            docs.append(shingle_hashes(text, self.width))
            held += len(docs[-1])
            if held >= BATCH_SHINGLES or at + 1 == len(texts):
                sets: dict[int, np.ndarray] = {}
                for doc, item in sorted(self.candidates(docs)):
                    if doc not in sets:
                        sets[doc] = np.unique(docs[doc])
                    mine, whole = self.sets[item], sets[doc]
                    place = np.minimum(np.searchsorted(whole, mine), len(whole) - 1)
                    shared = int((whole[place] == mine).sum())
                    if shared >= threshold * len(mine):
                        yield start + doc, self.ids[item], shared, len(mine)
                start, docs, held = at + 1, [], 0


def item_indexes(
    benchmark: DataFrame,
    width: int = WIDTH,
    functions: int = FUNCTIONS,
    seed: int = SEED,
    per_pass: int = SHINGLES_PER_PASS,
) -> Iterator[ItemIndex]:
    """The stated query set in blocks of at most `per_pass` words (or one longer item), one at a
    time."""
    now, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len((row["text"] or "").split()) + 1
        if now and held + size > per_pass:
            yield ItemIndex(now, width, functions, seed)
            now, held = [], 0
        now.append((row["item_id"], row["text"]))
        held += size
    if now:
        yield ItemIndex(now, width, functions, seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item contained in a document.

    Containment is the share of the item's distinct word shingles that the document has. Items
    of fewer words than a shingle are one shingle, which only an equally short document has;
    NULL and empty texts have none and match nothing. Repeated rows give repeated pairs, other
    columns are left out, empty tables give no pairs. Documents are never moved: each pass is
    one scan, with the items of one block (bounded by SHINGLES_PER_PASS) in every task.
    """
    spark = docs.sparkSession
    ship(spark)
    doc_key = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_key}, " + FOUND.format(key=benchmark.schema["item_id"].dataType.simpleString())
    blocks = item_indexes(benchmark)
    out, index = spark.createDataFrame([], schema), next(blocks, None)
    while index is not None:
        found = _pairs(docs.select("doc_id", "text"), index, threshold, schema)
        index = next(blocks, None)
        # Where more blocks come, this one's pairs are stored, so that one index is held at a time.
        out = out.unionByName(found if index is None else stored(found, "contaminated"))
    return out


def _pairs(docs: DataFrame, index: ItemIndex, threshold: float, schema: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sent.value.contained(batch.column(1).to_pylist(), threshold))
            if not found:
                continue
            at, items, shared, whole = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(items),
                    pa.array(shared, pa.int64()),
                    pa.array(whole, pa.int64()),
                    pa.array([s / w for s, w in zip(shared, whole, strict=True)], pa.float64()),
                ],
                names=["doc_id", "item_id", "n_shared", "n_item", "containment"],
            )

    return docs.mapInArrow(search, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that contain no item, whole and with all columns, without a shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    blocks = item_indexes(benchmark)
    index = next(blocks, None)
    while index is not None:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for found in sent.value.contained(batch.column(at).to_pylist(), threshold):
                    keep[found[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        index = next(blocks, None)
        if index is not None:
            docs = stored(docs, "decontaminated")
    return docs
