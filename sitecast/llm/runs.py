"""Periodic runs of words, found by recompression.

A block of documents becomes one sequence of word numbers with a number of its own between
documents. Block compression (a^k to one symbol) and pair compression (ab to one symbol, a and
b from the two sides of a random split of the alphabet) take turns until little is left; the
symbols of all levels are a run-length grammar of the sequence. Equal symbols have equal
expansions, so the common extension of two places is found in steps that grow and shrink with
the levels, logarithmic in its length, for whole arrays of place pairs at once.

A run of period p and length 4p or more holds a multiple g of 2p (counted from the document's
start) together with g + p and g + 2p, so these n/2 + n/4 + ... grid places are all candidates
there are; those where the three words agree are extended both ways by the grammar.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitecast.llm.common import ship

MIN_LENGTH, MIN_EXPONENT = 6, 4
# Sizes that bound memory, never the results: words of documents in one grammar (a longer
# document is one of its own) and candidates extended at a time.
GRAMMAR_WORDS, CANDIDATES = 1 << 18, 1 << 20
SMALL = 64

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def _numbered(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Equal keys to equal new symbols from `first` on."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return first + inverse, first + len(distinct)


def _groups(symbols: np.ndarray) -> np.ndarray:
    """Starts of the maximal blocks of one symbol."""
    return np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))


def _sides(symbols: np.ndarray, salt: int) -> np.ndarray:
    """A repeatable random side for every symbol."""
    x = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt * 2 + 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """All levels of a sequence whose first and last numbers occur nowhere else."""

    def __init__(self, words: np.ndarray, enough: int = SMALL):
        self.size = len(words)
        levels, firsts = [words.astype(np.int64)], []
        fresh = int(words.max()) + 1
        salt, idle = 0, 0
        while len(levels[-1]) > enough and idle < 8:
            now = levels[-1]
            starts = _groups(now)
            if len(starts) < len(now):
                lengths = np.diff(np.append(starts, len(now)))
                made, long = now[starts].copy(), lengths > 1
                made[long], fresh = _numbered(now[starts[long]] * (len(now) + 1) + lengths[long], fresh)
                levels.append(made)
                firsts.append(starts)
                now = made
            splits = [_sides(now, salt + i) for i in range(2)]
            pairs = [np.flatnonzero(~s[:-1] & s[1:]) for s in splits]
            salt += 2
            at = max(pairs, key=len)
            if not len(at):
                idle += 1
                continue
            idle = 0
            stays = np.ones(len(now), bool)
            stays[at + 1] = False
            starts = np.flatnonzero(stays)
            made = now[starts].copy()
            made[np.searchsorted(starts, at)], fresh = _numbered(now[at] * fresh + now[at + 1], fresh)
            levels.append(made)
            firsts.append(starts)
        self._link(levels, firsts)

    def _link(self, levels: list[np.ndarray], firsts: list[np.ndarray]) -> None:
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in levels])])
        kind = np.int32 if offsets[-1] < 1 << 31 else np.int64
        total = int(offsets[-1])
        self.symbol = np.concatenate(levels)
        # Of every symbol: its parent, first and last child, whether it is its parent's first or
        # last child, and how many equal symbols follow and precede it, itself counted.
        self.parent = np.zeros(total, kind)
        self.child = np.zeros((2, total), kind)
        self.edge = np.zeros((2, total), bool)
        self.equal = np.ones((2, total), kind)
        for i, symbols in enumerate(levels):
            here, n = offsets[i], len(symbols)
            starts = _groups(symbols)
            lengths = np.diff(np.append(starts, n))
            place = np.arange(n) - np.repeat(starts, lengths)
            self.equal[1, here : here + n] = place + 1
            self.equal[0, here : here + n] = np.repeat(lengths, lengths) - place
            if i < len(firsts):
                up, first = offsets[i + 1], firsts[i]
                sizes = np.diff(np.append(first, n))
                self.parent[here : here + n] = up + np.repeat(np.arange(len(first)), sizes)
                self.edge[0, here + first] = True
                self.edge[1, here + first + sizes - 1] = True
                self.child[0, up : up + len(first)] = here + first
                self.child[1, up : up + len(first)] = here + first + sizes - 1

    def extension(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """Length of the common part of the sequence from x and y on (or up to them, backwards)."""
        side, sign = int(back), -1 if back else 1
        symbol, parent, child = self.symbol, self.parent, self.child[side]
        edge, equal = self.edge[side], self.equal[side]
        out = np.zeros(len(x), np.int64)
        live, a, b = np.arange(len(x)), x.astype(np.int64), y.astype(np.int64)
        while len(live):
            up_a, up_b = parent[a], parent[b]
            rise = edge[a] & edge[b] & (symbol[up_a] == symbol[up_b])
            same = symbol[a] == symbol[b]
            step = np.minimum(equal[a], equal[b])
            done = ~rise & ~same & (a < self.size)
            if done.any():
                out[live[done]] = sign * (a[done] - x[live[done]])
                keep = ~done
                live, a, b, up_a, up_b = live[keep], a[keep], b[keep], up_a[keep], up_b[keep]
                rise, same, step = rise[keep], same[keep], step[keep]
            move_a = np.where(same, a + sign * step, child[a])
            move_b = np.where(same, b + sign * step, child[b])
            a, b = np.where(rise, up_a, move_a).astype(np.int64), np.where(rise, up_b, move_b).astype(np.int64)
        return out


def _candidates(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places g and periods p of all documents, at most about CANDIDATES at a time."""
    for start, n in _joined(starts, sizes):
        periods = n // MIN_EXPONENT
        doc = np.repeat(np.arange(len(n)), periods)
        p = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        counts = (n[doc] - 1) // (2 * p)
        upto = np.cumsum(counts)
        a = 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + CANDIDATES, "right")))
            some, c = np.arange(a, b), counts[a:b]
            pair = np.repeat(some, c)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c)
            yield start[doc[pair]] + 2 * p[pair] * k, p[pair]
            a = b


def _joined(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents that can hold a run."""
    long = sizes >= MIN_LENGTH
    if long.any():
        yield starts[long], sizes[long]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of several documents, whose word numbers lie one after another: document, start in
    it, length and period, in that order."""
    # A number of its own before every document and after the last one.
    marks = int(words.max(initial=0)) + 1 + np.arange(len(sizes) + 1)
    ends = np.cumsum(sizes)
    sequence = np.append(np.insert(words, ends - sizes, marks[:-1]), marks[-1])
    starts = ends - sizes + np.arange(len(sizes)) + 1
    grammar = Grammar(sequence, max(SMALL, 2 * len(sizes)))
    found = [np.zeros((3, 0), np.int64)]
    for g, p in _candidates(starts, sizes):
        same = sequence[g] == sequence[g + p]
        g, p = g[same], p[same]
        same = sequence[g] == sequence[g + 2 * p]
        g, p = g[same], p[same]
        right = grammar.extension(g, g + p)
        # The first grid place of a run lies less than 2p words from its start.
        left = np.zeros(len(g), np.int64)
        useful = right + 2 * p - 1 + p >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
        left[useful] = grammar.extension(g[useful] - 1, g[useful] + p[useful] - 1, back=True)
        length = left + right + p
        run = length >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
        rows = np.stack([g[run] - left[run], length[run], p[run]])
        found.append(np.unique(rows, axis=1))
    start, length, period = np.concatenate(found, axis=1)
    # The same stretch is found with multiples of its smallest period too.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    doc = np.searchsorted(starts, start, "right") - 1
    return doc, start - starts[doc], length, period


def _rows(texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Number of words, runs (document, start, length, period) and collapsed text of each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [t.split() for t in texts]  # of bytes: at the six ASCII white-space bytes
    sizes = np.array([len(w) for w in split], np.int64)
    words = np.fromiter((number[w] for part in split for w in part), np.int64, int(sizes.sum()))
    doc, start, length, period = find_runs(words, sizes)
    begin = np.cumsum(sizes) - sizes
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, begin[doc] + start + period, 1)
    np.add.at(cover, begin[doc] + start + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    collapsed = []
    for i, part in enumerate(split):
        if sizes[i] and gone[begin[i] : begin[i] + sizes[i]].any():
            part = [w for w, g in zip(part, gone[begin[i] : begin[i] + sizes[i]].tolist()) if not g]
        collapsed.append(b" ".join(part).decode())
    return sizes.tolist(), doc, start, length, period, collapsed


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about GRAMMAR_WORDS words, at six bytes a word, or one text."""
    a, held = 0, 0
    for b, text in enumerate(texts):
        if b > a and held + len(text) > 6 * GRAMMAR_WORDS:
            yield a, b
            a, held = b, 0
        held += len(text)
    if texts:
        yield a, len(texts)


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, runs (by start, then period) and the collapsed text.

    Words are runs of characters other than ASCII white space. A run is a stretch of words with
    smallest period q, of at least max(6, 4 q) words, that no neighbouring word extends; its
    start is the number of its first word, from 0. The collapsed text joins by single spaces the
    words that no run holds after its first q words. A NULL or empty text has no words, no runs
    and an empty collapsed text. Repeated rows and NULL doc_ids get a row each, an empty table
    none. Only `doc_id` and `text` are read, so other columns may have any name. A document is
    one unit of work, however long.
    """
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [raw.as_py() or b"" for raw in batch.column(1)]
            for a, b in _blocks(texts):
                sizes, doc, start, length, period, collapsed = _rows(texts[a:b])
                run = pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"]
                )
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends), run),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", F.col(text).cast("binary").alias("raw")).mapInArrow(find, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""

    def better(best: Column, run: Column) -> Column:
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def digests(found: DataFrame) -> DataFrame:
    """Per row of `periodic_runs`: n_runs, its strongest run and checksums of runs and text."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
