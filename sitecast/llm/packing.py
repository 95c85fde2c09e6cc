"""Best-fit packing of tokenised documents after a dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is the count of pieces per length:
at most `capacity` numbers, whatever the corpus. On these counts the Martello-Toth reduction
fixes sets that provably belong to some optimal packing, for all pieces of equal length at once,
and best-fit decreasing packs what is left. The resulting plan gives every (length, rank) its
sequence and offset; Spark ranks the pieces and places them without gathering any.
"""

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut, numbered, ship
from sitecast.llm.tokens import END_ID, encode_texts

CAPACITY = 1024
PIECES = "piece int, start long, length long, ids_crc32 long"
PLACES = "sequence_id long, offset long"


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be short of the capacity."""
    head = length % capacity if length > capacity else length
    if head:
        yield 0, head
    for start in range(head, length, capacity):
        yield start, capacity


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """doc_id and PIECES of every row: its ids (NULL text: none) and the end id, cut to pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for at, ids in enumerate(encode_texts(tokenizer, batch.column(1), end_id)):
                for number, (start, size) in enumerate(cuts(len(ids), capacity)):
                    owner.append(at)
                    rows.append((number, start, size, crc32_of(ids[start : start + size])))
            number, start, size, crc = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner, pa.int64())),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {key}, {PIECES}")


def reduce_by_dominance(counts: Counter, capacity: int) -> list[tuple[list[int], int]]:
    """Sets fixed by dominance, as (lengths, how often); takes them out of `counts`.

    A set with piece j dominates if every other feasible set with j could be exchanged for it
    without an extra bin: j with its exact complement; j with the largest companion where at
    most one fits; j with two companions where at most two fit, the first being the largest
    that fits and the second as large as any second can be.
    """
    fixed: list[tuple[list[int], int]] = []

    def largest(limit: int, without: tuple[int, ...] = ()) -> int:
        for size in range(min(limit, capacity), 0, -1):
            if counts[size] > without.count(size):
                return size
        return 0

    def smallest(n: int, without: int) -> list[int]:
        found: list[int] = []
        for size in sorted(s for s in counts if counts[s] > 0):
            found += [size] * min(n - len(found), counts[size] - (size == without))
            if len(found) == n:
                break
        return found

    def fix(sizes: list[int]) -> None:
        need = Counter(sizes)
        times = min(counts[s] // k for s, k in need.items())
        for s, k in need.items():
            counts[s] -= k * times
        fixed.append((sizes, times))

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j] > 0:
                room = capacity - j
                a = largest(room, (j,))
                low = smallest(3, j)
                if a == 0 or a == room:
                    fix([j, a] if a else [j])
                elif len(low) < 2 or sum(low[:2]) > room:
                    fix([j, a])
                elif len(low) < 3 or sum(low) > room:
                    b = largest(room - a, (j, a))
                    if b == 0 or b < largest(room // 2, (j,)):
                        break
                    fix([j, a, b])
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: Counter, capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing over counts: (lengths, how often) of the bins.

    Bins with one content are one entry. The tightest bin that takes a piece stays the tightest
    while another piece of that length fits, so it takes as many as it can before the next one.
    """
    open_bins: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(sizes: list[int], times: int) -> None:
        room = capacity - sum(sizes)
        if room not in open_bins:
            open_bins[room] = []
            insort(rooms, room)
        open_bins[room].append((sizes, times))

    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                sizes, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
            else:
                room, sizes, times = capacity, [], left
            each = min(room // size, left)
            taken = min(times, left // each)
            if sizes and times > taken:
                put(sizes, times - taken)
            put(sizes + [size] * each, taken)
            left -= taken * each
    return [group for groups in open_bins.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks that share an offset.

    A run covers the ranks `rank`, `rank` + 1, ... of `length`, up to the next run; they go to
    the sequences `sequence`, `sequence` + 1, ... at `offset`. Sorted by length and rank.
    """
    left = Counter(counts)
    groups = reduce_by_dominance(left, capacity)
    groups += best_fit(left, capacity)
    used: Counter = Counter()
    runs, sequence = [], 0
    for sizes, times in groups:
        offset = 0
        for size in sizes:
            runs.append((size, used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    runs.sort()
    names = ("length", "rank", "sequence", "offset")
    columns = zip(*runs, strict=True) if runs else ((),) * 4
    return {n: np.array(c, dtype=np.int64) for n, c in zip(names, columns, strict=True)}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (doc_id and PIECES) with sequence_id and offset.

    One global packing: the driver sees only the count of pieces per length. Every piece fits
    (lengths over the capacity are an error), sequences are gapless from offset 0, equal pieces
    and repeated rows are packed as often as they occur. No pieces give no rows.
    """
    ship(pieces.sparkSession)
    pieces = cut(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if counts and (max(counts) > capacity or min(counts) < 1):
        raise ValueError(f"lengths must be in 1..{capacity}")
    runs = plan(counts, capacity)
    first = (runs["length"] << 44) | runs["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rank = rows["rank"].to_numpy()
            at = np.searchsorted(first, (rows["length"].to_numpy() << 44) | rank, "right") - 1
            sequence = runs["sequence"][at] + rank - runs["rank"][at]
            rows = rows.drop_columns(["rank"])
            rows = rows.append_column("sequence_id", pa.array(sequence, pa.int64()))
            rows = rows.append_column("offset", pa.array(runs["offset"][at], pa.int64()))
            yield from rows.to_batches()

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    rows = pieces.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered(rows, "length", "rank").select(*pieces.columns, "rank")
    return rows.mapInArrow(place, f"{fields}, {PLACES}")


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Packed pieces of all `docs` (doc_id, text): doc_id, PIECES, sequence_id, offset.

    NULL and empty texts are documents of the end id alone. Other columns are left out.
    """
    return pack_pieces(token_pieces(docs, tokenizer, capacity, end_id), capacity)
