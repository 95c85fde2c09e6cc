"""Ranked lexical search by NRA (no random access).

Every term has a list of postings sorted by impact, the part of a document's score that the term
gives. Lists are read in that order only. A document that was met has a lower bound, what it
has collected, and an upper bound, which adds the next unread impact of every list it was not
met in. Reading goes on until no other document can reach the best `k`, and until the bounds of
those that can have met, so membership, ties and scores are exact.

Documents are dealt into blocks of bounded size, each with its own lists, read by one task; a
task keeps the best `k` of its blocks, and theirs start the next block's threshold. Statistics
(N, L, df) come from all documents first. Queries are taken in blocks of bounded size.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitecast.llm.common import ship, stored

TOP = 50
# Sizes that bound memory, never the results: text of the queries that travel to all tasks at a
# time, postings of a block of documents, and texts turned into rows at a time.
ITEM_BYTES = 8 << 20
BLOCK_POSTINGS = 1 << 21
TEXT_BYTES = 16 << 20
FIRST_READS, MORE = 256, 4
MERGE_CELLS = 64  # parts that a query's blocks are ranked in before they are ranked together

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


def _byte_table() -> bytes:
    """Bytes of a term as they are, A-Z in lower case; all others separate."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else ord(" ")
    return bytes(table)


BYTES = _byte_table()


def terms_of(raw: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(BYTES).split() if raw else []


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about TEXT_BYTES of text each, or one row."""
    sizes = batch.column(column).cast(pa.large_binary())
    lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1])
    part = np.cumsum(lengths) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def postings(docs: DataFrame, known: dict[bytes, int], text: str = "text") -> DataFrame:
    """Per document with a term: its number of terms, and number and count of the `known` ones."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for whole in batches:
            for batch in _slices(whole, 1):
                keep, ns, sizes, terms, tfs = [], [], [], [], []
                for row, raw in enumerate(batch.column(1)):
                    words = terms_of(raw.as_py())
                    if not words:
                        continue
                    tally = Counter(words)
                    held = tally.keys() & number.keys()
                    keep.append(row)
                    ns.append(len(words))
                    sizes.append(len(held))
                    terms.extend([number[t] for t in held])
                    tfs.extend([tally[t] for t in held])
                ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keep, pa.int64())),
                        pa.array(ns, pa.int64()),
                        pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(count, POSTINGS)


def _scaled(n: np.ndarray, many: int, total: int) -> np.ndarray:
    """50 + 50 n `many` div `total`, in Python's numbers where 64 bits might not do."""
    if int(n.max(initial=0)) * 50 * many < 1 << 62:
        return 50 + (50 * n * many) // total
    return np.array([50 + 50 * int(x) * many // total for x in n], np.int64)


class Lists:
    """Impact-sorted lists of a block of documents."""

    def __init__(self, n, ends, terms, tfs, weights, many, total):
        doc = np.repeat(np.arange(len(n), dtype=np.int32), np.diff(ends))
        m = _scaled(n, many, total)[doc]
        tfs = tfs.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))
        useful = impact > 0
        doc, terms, impact = doc[useful], terms[useful], impact[useful]
        order = np.lexsort((-impact, terms))
        self.doc, self.impact = doc[order], impact[order]
        self.at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.low = np.zeros(len(n), np.int64)
        self.seen = np.zeros(len(n), np.int64)

    def best(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """All documents whose score reaches the k-th best score and `floor`, with their scores."""
        starts, stops = self.at[query], self.at[query + 1]
        some = stops > starts
        starts, stops = starts[some], stops[some]
        heads = starts.copy()
        low, seen = self.low, self.seen
        reads, wanted = FIRST_READS, np.ones(len(starts), bool)
        while True:
            for i in np.flatnonzero(wanted):
                a, b = heads[i], min(heads[i] + reads, stops[i])
                low[self.doc[a:b]] += self.impact[a:b]
                heads[i] = b
            # The next unread impact of every list; a list read to its end has none.
            ended = heads >= stops
            ahead = np.where(ended, 0, self.impact[np.minimum(heads, len(self.impact) - 1)]) if len(heads) else heads
            unseen = int(ahead.sum())
            met = np.flatnonzero(low)
            lows = low[met]
            limit = max(floor, int(np.partition(lows, len(lows) - k)[len(lows) - k]) if len(lows) >= k else 1)
            # Upper bounds: all that is ahead, less what is ahead in the lists of a document's own.
            for i in np.flatnonzero(ahead):
                seen[self.doc[starts[i] : heads[i]]] += ahead[i]
            upper = lows + unseen - seen[met]
            seen[met] = 0
            can = upper >= limit
            if unseen < limit and not (upper[can] > lows[can]).any():
                found, scores = met[can], lows[can]
                low[met] = 0
                return found, scores
            wanted = ~ended
            if unseen < limit:
                # Only lists in which some document that still counts was not met yet matter.
                counts = np.zeros(len(low), bool)
                counts[met[can]] = True
                much = int(can.sum())
                for i in np.flatnonzero(wanted):
                    wanted[i] = np.count_nonzero(counts[self.doc[starts[i] : heads[i]]]) < much
            reads *= MORE


def _first(doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, then doc_id (documents without one last)."""
    return np.lexsort((doc, null, -score))[:k]


def _search(parts: Iterator[pa.RecordBatch], queries, weights, many, total, k) -> Iterator[pa.RecordBatch]:
    best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries]

    def read(block: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(block).combine_chunks()
        ids = table.column("doc_id").combine_chunks()
        doc, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        terms, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
        lists = Lists(
            table.column("n").to_numpy(),
            np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False))]),
            terms.flatten().to_numpy(zero_copy_only=False),
            tfs.flatten().to_numpy(zero_copy_only=False),
            weights,
            many,
            total,
        )
        for i, query in enumerate(queries):
            d, z, s = best[i]
            found, scores = lists.best(query, k, int(s[-1]) if len(s) == k else 1)
            if len(found):
                d, z = np.concatenate([d, doc[found]]), np.concatenate([z, null[found]])
                s = np.concatenate([s, scores])
                first = _first(d, z, s, k)
                best[i] = d[first], z[first], s[first]

    block, size = [], 0
    for batch in parts:
        step = max(1, int(BLOCK_POSTINGS * batch.num_rows / (len(batch.column(2).flatten()) + batch.num_rows)))
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            held = len(part.column(2).flatten()) + part.num_rows
            if block and size + held > BLOCK_POSTINGS:
                read(block)
                block, size = [], 0
            block.append(part)
            size += held
    if block:
        read(block)
    for i, (d, z, s) in enumerate(best):
        if len(d):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(d), i, np.int32)), pa.array(d, mask=z), pa.array(s)],
                names=["item", "doc_id", "score"],
            )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k per item: first of every cell of tasks, then of the cells' best."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    cells = found.withColumn("cell", F.pmod(F.spark_partition_id(), F.lit(MERGE_CELLS)))
    part = Window.partitionBy("item", "cell").orderBy(*order)
    some = cells.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    last = Window.partitionBy("item").orderBy(*order)
    return some.drop("cell").withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


def _item_blocks(items: DataFrame, text: str) -> Iterator[list]:
    """Items in blocks of about ITEM_BYTES of text (one item is never split), one at a time."""
    size = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = 2 * size // ITEM_BYTES + 1
    rows = items.select("item_id", F.col(text).cast("binary").alias("raw")).filter("raw IS NOT NULL")
    if n_blocks == 1:
        yield rows.collect()
        return
    # Both a NULL id and equal ids go to one block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(n_blocks)))
    dealt = stored(dealt, "search-items")
    for b in range(n_blocks):
        yield dealt.filter(F.col("block") == b).select("item_id", "raw").collect()


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text") -> DataFrame:
    """Per item its `k` best documents: item_id, rank (from 1), doc_id, score.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is
    50 + 50 n N div L, its score the sum of weight * (10^9 tf div (1000 tf + 20 m)) over the
    distinct terms of the item. N and L count documents with a term and their terms, df the
    documents with the term, n and tf terms of the document. Only scores above 0 are returned.

    Equal scores go by doc_id, documents without a doc_id after all others of their score; rows
    that share a doc_id are documents of their own. NULL and empty texts have no terms and are
    never found. Rows of one item_id (a NULL one too) make one item with the terms of all. Items
    without terms, and empty tables, give no rows. Only `doc_id`, `item_id` and `text` are read,
    so other columns may have any name.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = items.schema["item_id"].dataType.simpleString()
    out = None
    for rows in _item_blocks(items, text):
        wanted: dict = {}
        for row in rows:
            wanted.setdefault(row["item_id"], set()).update(terms_of(bytes(row["raw"])))
        wanted = {i: t for i, t in wanted.items() if t}
        if not wanted:
            continue
        known = {t: i for i, t in enumerate(sorted(set().union(*wanted.values())))}
        lists = stored(postings(docs, known, text), "search-postings")
        stats = lists.agg(F.count("*").alias("many"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        if not stats["many"]:
            continue
        df = np.zeros(len(known), np.int64)
        for term, n in lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[term] = n
        many, total = stats["many"], stats["total"]
        weights = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * int(n) + 1))) for n in df], np.int64)
        queries = [np.array(sorted(known[t] for t in terms), np.int64) for terms in wanted.values()]
        shared = spark.sparkContext.broadcast((queries, weights))

        def find(parts, shared=shared, many=many, total=total):
            return _search(parts, *shared.value, many, total, k)

        ranked = _ranked(lists.mapInArrow(find, FOUND), k)
        names = spark.createDataFrame(list(enumerate(wanted)), f"item int, item_id {id_type}")
        found = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id long, score long")
    return out
