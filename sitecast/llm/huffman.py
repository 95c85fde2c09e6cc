"""Token ids as canonical, length-limited Huffman codes in independent blocks.

File format (Parquet, one row per block of whole documents in ascending doc_id order):
`part`, `block` (order of the blocks), `doc_id` and `n_tokens` (arrays, one entry per document),
`payload` (the codes, most significant bit first, padded to a byte) and `checkpoints` (the bit
offset of every 128th token, little-endian unsigned 32-bit). The codebook next to it holds the
code length of every id; canonical codes follow from the lengths alone. A block needs nothing
but the codebook, and its checkpoints let one table step decode all its 128-token runs at once.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitecast.llm.common import ship, stored
from sitecast.llm.tokens import END_ID, encode_texts

MAX_BITS = 16
BLOCK_TOKENS, CHECKPOINT = 1 << 17, 128
IDS = "part int, block int, doc_id array<{key}>, n_tokens array<bigint>, ids binary"
BLOCKS = "part int, block int, doc_id array<{key}>, n_tokens array<bigint>, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code length per id, `max_bits` at most; 0 for ids that do not occur.

    Package-merge: the 2n - 2 cheapest packages of the last level; the length of an id is the
    number of packages that hold it. A package is one id or two packages of the level before,
    so it is enough to count, level by level from the top, how many single ids were taken.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids do not fit into {max_bits} bits")
    by_weight = used[np.argsort(counts[used], kind="stable")]
    single = counts[by_weight].astype(np.float64)
    packages = np.array([])
    is_single: list[np.ndarray] = []
    for _ in range(max_bits):
        weights = np.concatenate([single, packages])
        rank = np.argsort(weights, kind="stable")
        is_single.append(rank < len(single))
        merged = weights[rank]
        pairs = len(merged) // 2 * 2
        packages = merged[0:pairs:2] + merged[1:pairs:2]
    taken = 2 * len(single) - 2
    for level in reversed(is_single):
        own = int(level[:taken].sum())
        lengths[by_weight[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


@dataclass(frozen=True)
class Codebook:
    """Canonical codes: ids of one length get consecutive codes in order of id."""

    lengths: np.ndarray

    def codes(self) -> np.ndarray:
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        codes = np.zeros(len(self.lengths), dtype=np.uint32)
        code, bits = 0, 0
        for n in np.unique(self.lengths[order]).tolist():
            code <<= n - bits
            bits = n
            mine = order[self.lengths[order] == n]
            codes[mine] = code + np.arange(len(mine), dtype=np.uint32)
            code += len(mine)
        return codes

    def table(self, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Id and code length for every run of `max_bits` bits."""
        ids = np.zeros(1 << max_bits, dtype=np.uint16)
        bits = np.zeros(1 << max_bits, dtype=np.uint8)
        used = np.flatnonzero(self.lengths)
        spare = max_bits - self.lengths[used].astype(np.int64)
        start = self.codes()[used].astype(np.int64) << spare
        order = np.argsort(start)
        reach = (1 << spare)[order]
        end = int(reach.sum())
        ids[:end] = np.repeat(used[order], reach)
        bits[:end] = np.repeat(self.lengths[used][order], reach)
        return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and checkpoints of a run of ids."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    total = int(ends[-1]) if len(ends) else 0
    starts = ends - bits
    code = codes[ids].astype(np.uint64)
    # Two neighbours make one code of 32 bits at most, which lies in two words of 32 bits;
    # codes share words but never bits, so sums put them together.
    odd = len(code) % 2
    pair = (code[: len(code) - odd : 2] << bits[1::2].astype(np.uint64)) | code[1::2]
    at = starts[: len(code) - odd : 2]
    size = bits[: len(code) - odd : 2] + bits[1::2]
    if odd:
        pair, at, size = np.append(pair, code[-1]), np.append(at, starts[-1]), np.append(size, bits[-1])
    window = pair << (64 - (at & 31) - size).astype(np.uint64)
    words = total // 32 + 2
    first = at >> 5
    packed = np.bincount(first, (window >> np.uint64(32)).astype(np.float64), words)
    packed[1:] += np.bincount(first, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), words)[:-1]
    payload = packed.astype(np.uint32).astype(">u4").tobytes()[: (total + 7) // 8]
    return payload, starts[::CHECKPOINT].astype("<u4").tobytes()


def decode_block(
    payload: bytes, checkpoints: bytes, total: int, table: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """The ids of a block: one table step per place, for all runs between checkpoints at once."""
    raw = np.frombuffer(payload + bytes(4), dtype=np.uint8)
    # The 24 bits that begin at every byte.
    window = (raw[:-2].astype(np.uint32) << 16) | (raw[1:-1].astype(np.uint32) << 8) | raw[2:]
    at = np.frombuffer(checkpoints, dtype="<u4").astype(np.int64)
    ids, bits = table
    out = np.zeros((CHECKPOINT, len(at)), dtype=np.uint16)
    short = total - (len(at) - 1) * CHECKPOINT  # tokens of the last run
    for place in range(min(CHECKPOINT, total)):
        if place == short:
            at = at[:-1]
        key = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[place, : len(at)] = ids[key]
        at = at + bits[key]
    return out.T.reshape(-1)[:total]


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Stored blocks of ids in ascending doc_id order (NULL first), whole documents each.

    The texts are dealt by ranges of doc_id (rows of one doc_id by their place in the input, so
    a repeated doc_id can be split) and encoded in order. A block closes at BLOCK_TOKENS ids or
    with its partition.
    """
    ship(docs.sparkSession)
    key = docs.schema["doc_id"].dataType
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    parts = max(rows.rdd.getNumPartitions(), 1)
    ordered = rows.repartitionByRange(parts, F.asc("doc_id"), "_row").sortWithinPartitions(
        F.asc("doc_id"), "_row"
    )
    fields = ["part", "block", "doc_id", "n_tokens", "ids"]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sizes, data, held, number, part = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            columns = [[part], [number], [names], [sizes], [b"".join(data)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(kind), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=fields)

        for batch in batches:
            kind = batch.schema.field(0).type
            owners = batch.column(0).to_pylist()
            part = batch.column(2)[0].as_py() if batch.num_rows else part
            ids_of = encode_texts(tokenizer, batch.column(1), end_id)
            for owner, ids in zip(owners, ids_of, strict=True):
                names.append(owner)
                sizes.append(len(ids))
                data.append(ids.tobytes())
                held += len(ids)
                if held >= BLOCK_TOKENS:
                    yield closed()
                    names, sizes, data, held, number = [], [], [], 0, number + 1
        if names:
            yield closed()

    dealt = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    made = dealt.mapInArrow(blocks, IDS.format(key=key.simpleString()))
    return stored(made, "token-ids")


def id_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often every id below `size` occurs, over all blocks; one row per id and task moves."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for row in rows.collect():
        counts[row["id"]] = row["n"]
    return counts


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, size: int = 1 << 16) -> None:
    """Writes all `docs` (doc_id, text) to `path`/blocks and `path`/codebook.

    NULL and empty texts are documents of the end id alone; repeated rows are documents of
    their own; other columns are left out; an empty table gives files without rows.
    """
    blocks = token_blocks(docs, tokenizer, end_id)
    book = Codebook(code_lengths(id_counts(blocks, size)))
    codes, lengths = book.codes(), book.lengths

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column(4)[0].as_buffer(), "<u2")
                payload, checkpoints = encode_block(ids, codes, lengths)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:4], pa.array([payload]), pa.array([checkpoints])],
                    names=["part", "block", "doc_id", "n_tokens", "payload", "checkpoints"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    out = blocks.mapInArrow(encoded, BLOCKS.format(key=key))
    out.write.option("compression", "none").parquet(f"{path}/blocks")
    used = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark = docs.sparkSession
    spark.createDataFrame(used, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")


def read_codebook(spark: SparkSession, path: str, size: int = 1 << 16) -> Codebook:
    lengths = np.zeros(size, dtype=np.uint8)
    for row in spark.read.parquet(f"{path}/codebook").collect():
        lengths[row["id"]] = row["bits"]
    return Codebook(lengths)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of written files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    return _decoded(spark, path, "ids binary", lambda ids: ids.astype("<u2").tobytes(), pa.binary())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As `read_documents`, with the crc32 of the ids (little-endian, 32 bits) in their place."""
    return _decoded(
        spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()
    )


def _decoded(spark: SparkSession, path: str, field: str, value, kind: pa.DataType) -> DataFrame:
    ship(spark)
    table = read_codebook(spark, path).table()
    blocks = spark.read.parquet(f"{path}/blocks")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = np.array(batch.column(3)[i].as_py(), dtype=np.int64)
                ends = np.cumsum(sizes)
                payload, checkpoints = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                ids = decode_block(payload, checkpoints, int(ends[-1]), table)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([i] * n)),
                        batch.column(1).take(pa.array([i] * n)),
                        batch.column(2)[i].values,
                        pa.array(ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array([value(x) for x in np.split(ids, ends[:-1])], kind),
                    ],
                    names=["part", "block", "doc_id", "within", "n_tokens", field.split()[0]],
                )

    key = blocks.schema["doc_id"].dataType.elementType.simpleString()
    schema = f"part int, block int, doc_id {key}, within long, n_tokens long, {field}"
    found = blocks.mapInArrow(documents, schema)
    # Two running sums: of the blocks of a part, and of the parts, which are as few as files.
    sizes = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    of_part = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = of_part.select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    starts = sizes.join(bases, "part").select(
        "part", "block", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first")
    )
    return found.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", field.split()[0]
    )
