"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most `max_bits` bits differ in at most as many of
their eight bytes, so they share at least 8 - max_bits (position, byte) pairs: the guaranteed
matches. The index posts each distinct fingerprint under keys of several positional bytes at
once, chosen so that any two fingerprints with the guaranteed matches meet under some key;
under a key the shared positional bytes of each pair are tallied, pairs below the guaranteed
number are dropped, and the rest are verified by their bits.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut, free_name, quoted, ship
from sitecast.llm.components import components
from sitecast.llm.shingles import shingle_hashes

SHINGLE, MAX_BITS = 3, 2
# Distinct fingerprints under one key whose pairs are tallied directly; longer lists are posted
# again under keys with more positions, down to the guaranteed number of matches.
LIST_LENGTH = 512
POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the shingles of a text, repeats included; 0 without a word.

    A-Z are lower-cased; a bit is set if it is set in more than half of the hashes.
    """
    hashes = shingle_hashes(text, width).astype(">u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """`docs` with `fp`, the fingerprint as a signed long, in place of the text."""
    ship(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, width) for t in batch.column(batch.num_columns - 1).to_pylist()]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            names = [*batch.schema.names[:-1], "fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(signed)], names=names)

    kept = [c for c in docs.columns if c not in (text, "fp")]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)
    return docs.select(*kept, text).mapInArrow(hashed, schema + "fp long")


def _masks(positions: int, chosen: int) -> list[int]:
    """Masks over eight bytes that keep `chosen` of `positions` equal runs of positions."""
    width = 8 // positions
    byte = [0xFF << (8 * (7 - i)) for i in range(8)]
    runs = [sum(byte[i * width : (i + 1) * width]) for i in range(positions)]
    return [sum(runs[i] for i in some) for some in combinations(range(positions), chosen)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _keys(masks: list[int]) -> Column:
    """Array of (mask number, positional bytes) under which a fingerprint is posted."""
    one = [
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes"))
        for i, m in enumerate(masks)
    ]
    return F.array(*one)


def tally(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Links that connect what is connected among `fps` (distinct, uint64): pairs of places.

    Shared positional bytes are counted for every pair, in rows of one fingerprint against all;
    pairs with the guaranteed matches are verified. A spanning forest of the verified links is
    returned, found breadth first, so a list of n gives at most n - 1 links.
    """
    need = 8 - max_bits
    as_bytes = fps.astype(">u8").view(np.uint8).reshape(-1, 8)
    waiting = np.ones(len(fps), dtype=bool)
    links = []
    for root in range(len(fps)):
        if not waiting[root]:
            continue
        waiting[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            others = np.flatnonzero(waiting)
            if not len(others):
                break
            matches = (as_bytes[others] == as_bytes[at]).sum(axis=1)
            others = others[matches >= need]
            apart = (fps[others] ^ fps[at]).view(np.uint16).reshape(-1, 4)
            near = others[POPCOUNT[apart].sum(axis=1) <= max_bits]
            waiting[near] = False
            links += [(at, int(i)) for i in near]
            queue += near.tolist()
    return np.array(links, dtype=np.int64).reshape(-1, 2)


def _tallied(posted: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) from the lists of `posted` (mask, bytes, fp), read in order of their key."""
    ship(posted.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = key = fps = np.array([], dtype=np.int64)

        def links(mask: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((key[1:] != key[:-1]) | (mask[1:] != mask[:-1])) + 1
            bounds = np.concatenate([[0], new, [len(key)]])
            found = []
            for i in np.flatnonzero(np.diff(bounds) > 1):
                some = fps[bounds[i] : bounds[i + 1]]
                pairs = tally(some.view(np.uint64), max_bits)
                found.append(some[pairs])
            ends = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"]
            )

        for batch in batches:
            mask = np.concatenate([mask, batch.column(0).to_numpy()])
            key = np.concatenate([key, batch.column(1).to_numpy()])
            fps = np.concatenate([fps, batch.column(2).to_numpy()])
            # The last list may go on in the next batch.
            same = (key == key[-1]) & (mask == mask[-1]) if len(key) else np.array([], dtype=bool)
            whole = len(key) - int(same.sum())
            yield links(mask[:whole], key[:whole], fps[:whole])
            mask, key, fps = mask[whole:], key[whole:], fps[whole:]
        yield links(mask, key, fps)

    parts = posted.select(F.col("mask").cast("long"), "bytes", "fp").repartition("mask", "bytes")
    return parts.sortWithinPartitions("mask", "bytes", "fp").mapInArrow(linked, "u long, v long")


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (`fp`) that connect all that are near.

    Keys of four positions (two of the four byte pairs): any two fingerprints with six shared
    bytes meet under one of the six. A list of more than LIST_LENGTH is posted again under the
    keys of six positions, all that the guarantee leaves, where a list differs in two bytes only
    and holds at most 65,536 fingerprints. List lengths are counted with partial sums, so a
    frequent key never meets in one task.
    """
    if max_bits != 2:
        raise ValueError("the keys are chosen for two differing bits")
    wide, narrow = _masks(4, 2), _masks(8, 6)
    posted = fingerprints.select("fp", F.explode(_keys(wide)).alias("k")).select("k.*", "fp")
    lengths = posted.groupBy("mask", "bytes").count().filter(F.col("count") > 1)
    lists = posted.join(lengths, ["mask", "bytes"])
    lists = cut(lists)
    short = lists.filter(F.col("count") <= LIST_LENGTH).select("mask", "bytes", "fp")
    long = lists.filter(F.col("count") > LIST_LENGTH).select("fp").distinct()
    again = long.select("fp", F.explode(_keys(narrow)).alias("k"))
    again = again.select((F.col("k.mask") + len(wide)).alias("mask"), "k.bytes", "fp")
    return _tallied(short.unionByName(again), max_bits)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    width: int = SHINGLE,
    max_bits: int = MAX_BITS,
    carried: list[str] | None = None,
) -> DataFrame:
    """Per row of `docs`: doc_id, the `carried` columns, fingerprint (16 hex digits),
    component_id and class_fp.

    Rows are near if their fingerprints differ in at most `max_bits` bits; component_id is the
    smallest doc_id (of those that are not NULL) that can be reached, class_fp the fingerprint
    that stands for the component, which also tells apart components without a doc_id. NULL and
    empty texts have fingerprint zero and are linked like any others. Repeated rows and rows
    with one doc_id get a row each; an empty table gives an empty one. Fingerprints are reduced
    to the distinct ones before anything is compared, so copies cost one partial sum each.
    """
    kept = ["doc_id", *(carried or [])]
    prints = cut(with_fingerprint(docs.select(*kept, text), text, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("smallest")))
    found = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    classes = named.select("fp", "root").join(smallest, "root")
    return prints.join(classes, "fp").select(
        *kept,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.lower(F.lpad(F.hex("root"), 16, "0")).alias("class_fp"),
    )


def keep_one(
    docs: DataFrame, text: str = "text", width: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row of `docs` per component: the one with its smallest doc_id.

    Of rows that share this doc_id, or of a component without any doc_id, the one with the
    smallest hash of its text stays; of equal rows any one. Columns may have any names; their
    values are those of `docs`.
    """
    key, own_id, own_key = (free_name(docs, n) for n in ("_text_hash", "_kept_id", "_kept_hash"))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    found = near_duplicates(keyed, text, width, max_bits, [key])
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = first.groupBy("class_fp").agg(F.first("component_id").alias(own_id), F.min(key).alias(own_key))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key))
    kept = keyed.join(chosen.select(own_id, own_key), same, "left_semi")
    return kept.dropDuplicates(["doc_id", key]).select(*[quoted(c) for c in docs.columns])
