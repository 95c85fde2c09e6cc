"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model has order six over UTF-8 bytes, so it knows any script, and its n-grams of all orders
grow with the trusted texts. Nothing holds it as a whole: n-grams lie in shards by the two bytes
before the last, which has every order from three on with its contexts in one shard. Documents
are dealt into blocks; a block sends the distinct n-grams of all its texts to the shards, once
each, with how often its trusted texts have them. The shards sum these counts, answer each block
with its probabilities, and the block scores its texts. Shards and blocks are as many as the
corpus has bytes for.

Limits come from label-quality-1 texts that the model they are scored with has not seen, by
language and length.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sitecast.llm.common import bytes_of, cut, free_name, quoted, ship
from sitecast.operators.chunks import running

# Bytes of an n-gram, 3 to 8: it is kept in 64 bits.
ORDER = 6
BYTES = 256
# Bytes of text for each shard and for each block of documents.
SHARD_BYTES, BLOCK_BYTES, LEAST_SHARDS = 8_000_000, 24_000_000, 4
LANGUAGE_PARTS = 64
# Bytes of text whose n-grams are taken at a time.
SLICE_BYTES, TALLY_ROWS = 2_000_000, 4_000_000
QUANTILE, MIN_TRUSTED, BIN = 0.99, 20, 1e-3
DEFAULT_DISCOUNTS = (0.5, 0.75, 0.9)


def codes_of(raw: bytes, order: int) -> np.ndarray:
    """The n-gram that ends at each byte of `raw`, after order - 1 line ends, first byte highest."""
    wide = np.frombuffer(b"\n" * (order - 1) + raw, dtype=np.uint8).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for i in range(order):
        out = (out << np.uint64(8)) | wide[i : i + len(raw)]
    return out


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _last(codes: np.ndarray, order: int) -> np.ndarray:
    """The last `order` bytes of n-grams."""
    return codes & np.uint64((1 << 8 * order) - 1)


def packed(codes: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted codes as steps, and counts, each as planes of bytes, compressed."""
    steps = np.diff(codes.astype(np.uint64), prepend=np.uint64(0))
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T) for x in (steps, *counts)]
    sizes = np.array([len(planes), len(codes)], "<u8")
    return zstandard.compress(b"".join(x.tobytes() for x in (sizes, *planes)), 3)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    k, n = np.frombuffer(raw, "<u8", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, offset=16).reshape(k, 8, n)
    out = [np.ascontiguousarray(p.T).view("<u8").reshape(n) for p in planes]
    return [np.cumsum(out[0], dtype=np.uint64), *[x.astype(np.int64) for x in out[1:]]]


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last."""
    mixed = (_last(codes, 3) >> np.uint64(8)) * np.uint64(2654435761) >> np.uint64(7)
    return (mixed % np.uint64(shards)).astype(np.int64)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    every, place = np.unique(np.concatenate([np.array([], np.uint64), *codes]), return_inverse=True)
    both = np.concatenate([np.array([], np.int64), *counts])
    return every, np.bincount(place, both, len(every)).astype(np.int64)


class _Tally:
    """Sums of counts per code; what is added waits until it is as much as what is there."""

    def __init__(self):
        self.codes, self.counts, self.size = [], [], 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.codes.append(codes)
        self.counts.append(counts)
        self.size += len(codes)
        if self.size > max(TALLY_ROWS, 2 * len(self.codes[0])):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = _summed(self.codes, self.counts)
        self.codes, self.counts, self.size = [codes], [counts], len(codes)
        return codes, counts


class _Places:
    """Where codes lie in a sorted array that has them all: by a hash, else by bisection."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bits = codes, (4 * len(codes) + 1).bit_length()
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self._slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def of(self, codes: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(codes)]
        lost = np.flatnonzero(self.codes[at] != codes)
        at[lost] = np.searchsorted(self.codes, codes[lost])
        return at


def _fold(raw: bytes) -> int:
    """One of two folds, the same for equal texts."""
    return zlib.crc32(raw) & 1


def discounts(found: dict[int, int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams occur 1 to 4 times.

    Where a number is missing the formula has no value; fixed discounts stand in.
    """
    n = [found.get(k, 0) for k in (1, 2, 3, 4)]
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for k in (1, 2, 3):
        value = k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] and n[k] else DEFAULT_DISCOUNTS[k - 1]
        out.append(min(max(value, 0.05), k - 0.05))
    return np.array(out)


def lower_orders(bigrams: dict[int, int]) -> np.ndarray:
    """p(c | b) for all 2^16 bigrams, from their continuation counts."""
    codes = np.array(sorted(bigrams), dtype=np.int64)
    m = np.array([bigrams[c] for c in codes.tolist()], dtype=np.int64)
    uniform = np.full(BYTES, 1 / BYTES)
    if not len(codes):
        return np.tile(uniform, BYTES)
    single, m1 = np.unique(codes & 0xFF, return_counts=True)
    d1 = discounts(dict(zip(*np.unique(m1, return_counts=True), strict=True)))[np.minimum(m1, 3)]
    p1 = uniform * d1.sum() / m1.sum()
    p1[single] += (m1 - d1) / m1.sum()
    d2 = discounts(dict(zip(*np.unique(m, return_counts=True), strict=True)))[np.minimum(m, 3)]
    total = np.bincount(codes >> 8, m, BYTES)
    free = np.where(total > 0, np.bincount(codes >> 8, d2, BYTES) / np.maximum(total, 1), 1.0)
    p2 = (free[:, None] * p1[None, :]).reshape(-1)
    p2[codes] += (m - d2) / total[codes >> 8]
    return p2


class Levels:
    """The n-grams of orders three and up of one shard, of counts of those of the highest order."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.of = {order: (codes, counts)}
        for m in range(order - 1, 1, -1):
            self.of[m] = np.unique(_last(self.of[m + 1][0], m), return_counts=True)

    def frequencies(self) -> list[tuple[int, int, int]]:
        """(order, count up to 4, n-grams that have it), and (2, bigram, its continuations)."""
        out = [(2, c, n) for c, n in zip(*(x.tolist() for x in self.of[2]), strict=True)]
        for m, (_, counts) in self.of.items():
            if m > 2:
                out += [(m, k, int((counts == k).sum())) for k in (1, 2, 3, 4)]
        return out

    def log_probabilities(self, codes: np.ndarray, cuts: dict[int, np.ndarray], p2: np.ndarray) -> np.ndarray:
        """log p of the last byte of sorted n-grams after the others."""
        p = p2[_last(codes, 2).astype(np.int64)]
        for m in sorted(self.of)[1:]:
            known, counts = self.of[m]
            if not len(known):
                continue
            cut_off = cuts[m][np.minimum(counts, 3)]
            contexts, place = np.unique(known >> np.uint64(8), return_inverse=True)
            total = np.bincount(place, counts)
            mine = _last(codes, m)
            at = np.minimum(np.searchsorted(contexts, mine >> np.uint64(8)), len(contexts) - 1)
            met = contexts[at] == mine >> np.uint64(8)
            p[met] *= (np.bincount(place, cut_off) / total)[at[met]]
            at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            met = known[at] == mine
            p[met] += ((counts - cut_off) / total[place])[at[met]]
        return np.log(p)


# Which counts a model has: those of all trusted texts, or of one fold.
_ALL, _FOLDS = 2, (0, 1)


def _counts_of(n: list[np.ndarray], which: int) -> np.ndarray:
    return n[0] + n[1] if which == _ALL else n[which]


def _dealt(docs: DataFrame, block: Column) -> DataFrame:
    """(block, rows): the columns of `docs`, bundled per block and Arrow batch, compressed."""
    names = docs.columns

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(len(names)).to_numpy()
            rows = pa.RecordBatch.from_arrays(batch.columns[: len(names)], names=names)
            found, bundles = np.unique(blocks), []
            for k in found.tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows.take(pa.array(np.flatnonzero(blocks == k))))
                bundles.append(zstandard.compress(sink.getvalue(), 6))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int32()), pa.array(bundles, pa.binary())], names=["block", "rows"]
            )

    return docs.withColumn("_block", block).mapInArrow(bundle, "block int, rows binary")


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def _flags(rows: pa.Table, ids: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a label of quality 1, and which of these are trusted."""
    good = pc.is_in(rows["doc_id"], ids["doc_id"].combine_chunks(), skip_nulls=True)
    trusted = pc.is_in(rows["doc_id"], ids.filter(ids["trusted"])["doc_id"].combine_chunks(), skip_nulls=True)
    return tuple(x.to_numpy().astype(bool) for x in (good, trusted))


def _tallied(bundles, ids: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a block: the n-grams that its trusted texts do not have, those they have, and how often
    in either fold; each sorted."""
    empty, tallies = np.array([], np.uint64), [_Tally(), _Tally(), _Tally()]
    for bundle in bundles:
        rows = _table(bundle.as_py())
        _, trusted = _flags(rows, ids)
        texts, size = [[], [], []], 0
        for i, text in enumerate(rows["text"]):
            raw = _encoded(text.as_py())
            texts[_fold(raw) if trusted[i] else 2].append(codes_of(raw, order))
            size += len(raw)
            if size < SLICE_BYTES and i < rows.num_rows - 1:
                continue
            for tally, found in zip(tallies, texts, strict=True):
                tally.add(*np.unique(np.concatenate([empty, *found]), return_counts=True))
            texts, size = [[], [], []], 0
    (*codes, seen), (*counts, _) = zip(*(t.sums() for t in tallies), strict=True)
    own = np.union1d(*codes)
    n = [np.zeros(len(own), np.int64) for _ in _FOLDS]
    for k in _FOLDS:
        n[k][np.searchsorted(own, codes[k])] = counts[k]
    return np.setdiff1d(seen, own, assume_unique=True), own, n


def _asked(dealt: DataFrame, ids: DataFrame, order: int, shards: int) -> DataFrame:
    """What each block asks of each shard: block, shard, others, own.

    `own` has the n-grams of its trusted texts with their counts in either fold, `others` the
    rest. Under shard -1 it has the block's part of `ids`.
    """

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        others, own, n = _tallied(left["rows"], right, order)
        at_own, at_others = _shard_of(own, shards), _shard_of(others, shards)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, right.schema) as out:
            out.write_table(right)
        block = (left if left.num_rows else right)["block"][0].as_py()
        asked = [(block, -1, b"", zstandard.compress(sink.getvalue(), 3))] if left.num_rows else []
        for k in np.union1d(at_own, at_others).tolist():
            mine = at_own == k
            asked.append((block, k, packed(others[at_others == k]), packed(own[mine], n[0][mine], n[1][mine])))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        arrays = [pa.array([a[i] for a in asked], t) for i, t in enumerate(kinds)]
        return pa.Table.from_arrays(arrays, names=["block", "shard", "others", "own"])

    return (
        dealt.groupBy("block")
        .cogroup(ids.groupBy("block"))
        .applyInArrow(ask, "block int, shard int, others binary, own binary")
    )


def _counted(asked: DataFrame) -> DataFrame:
    """(shard, grams): n-grams of all trusted texts and their counts in either fold."""

    def count(part: pa.Table) -> pa.Table:
        codes, n = np.array([], np.uint64), [np.array([], np.int64)] * 2
        for data in part["own"]:
            new, *more = unpacked(data.as_py())
            n = [_summed([codes, new], [n[k], more[k]])[1] for k in _FOLDS]
            codes = np.union1d(codes, new)
        return pa.table({"shard": part["shard"].slice(0, 1), "grams": pa.array([packed(codes, *n)], pa.binary())})

    return asked.filter("shard >= 0").select("shard", "own").groupBy("shard").applyInArrow(count, "shard int, grams binary")


def _frequencies(counted: DataFrame, order: int) -> dict[tuple[int, int], dict[int, int]]:
    """Levels.frequencies of each model, summed over the shards: {(model, order): {key: n}}.

    At most 2^16 bigrams and four numbers per order and model reach the driver.
    """

    def of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                codes, *n = unpacked(data)
                for which in (*_FOLDS, _ALL):
                    mine = _counts_of(n, which)
                    rows = Levels(codes[mine > 0], mine[mine > 0], order).frequencies()
                    arrays = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                    model = pa.array([which] * len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays([model, *arrays], names=["model", "m", "key", "n"])

    rows = counted.select("grams").mapInArrow(of_shard, "model long, m long, key long, n long")
    out = {(which, m): {} for which in (*_FOLDS, _ALL) for m in range(2, order + 1)}
    for r in rows.groupBy("model", "m", "key").agg(F.sum("n").alias("n")).collect():
        out[r["model"], r["m"]][r["key"]] = r["n"]
    return out


def _answered(asked: DataFrame, counted: DataFrame, order: int) -> DataFrame:
    """(block, shard, logs): log p of `others` and `own` under all trusted texts, then of the
    n-grams of either fold under the texts of the other one, in the order of the n-grams. These
    stay behind: a block finds its n-grams again in its texts."""
    found = _frequencies(counted, order)
    models = {
        which: (
            {m: discounts(found[which, m]) for m in range(3, order + 1)},
            lower_orders(found[which, 2]),
        )
        for which in (*_FOLDS, _ALL)
    }

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        known, *n = unpacked(right["grams"][0].as_py())
        parts: list[list[np.ndarray]] = [[] for _ in range(left.num_rows)]
        # One model at a time is in memory; a fold's texts are held against that of the other one.
        for which in (_ALL, 1, 0):
            counts = _counts_of(n, which)
            levels = Levels(known[counts > 0], counts[counts > 0], order)
            for out, others, own in zip(parts, left["others"], left["own"], strict=True):
                mine, *seen = unpacked(own.as_py())
                asked_of = [unpacked(others.as_py())[0], mine] if which == _ALL else [mine[seen[1 - which] > 0]]
                out += [levels.log_probabilities(x, *models[which]).astype("<f4") for x in asked_of]
        logs = [np.concatenate(out).tobytes() for out in parts]
        return pa.table({"block": left["block"], "shard": left["shard"], "logs": pa.array(logs, pa.binary())})

    return (
        asked.filter("shard >= 0")
        .groupBy("shard")
        .cogroup(counted.groupBy("shard"))
        .applyInArrow(answer, "block int, shard int, logs binary")
    )


def perplexities(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """The columns of `docs` but its last, the text, with n_bytes, nats and held per row.

    nats is the mean of -log p per byte, NULL without bytes. held has it for texts of label
    quality 1 under a model that has not seen them: trusted texts, which that of nats has seen,
    are scored with those of the other one of two folds. Texts move twice, compressed.
    """
    ship(docs.sparkSession)
    *own, _ = docs.columns
    size = docs.agg(F.sum(bytes_of(F.col("text")))).first()[0] or 0
    shards, blocks = max(LEAST_SHARDS, -(-size // SHARD_BYTES)), max(1, -(-size // BLOCK_BYTES))
    key = docs.schema["doc_id"].dataType
    by_id = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    by_text = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")
    ids = (
        labels.filter("quality = 1 and doc_id is not null")
        .select(F.col("doc_id").cast(key).alias("doc_id"), (F.coalesce("toxic", F.lit(0)) == 0).alias("trusted"))
        .groupBy("doc_id")
        .agg(F.max("trusted").alias("trusted"))
        .select("doc_id", "trusted", by_id.alias("block"))
    )
    dealt = _dealt(docs, F.when(F.col("doc_id").isNotNull(), by_id).otherwise(by_text))
    asked = cut(_asked(dealt, ids, order, shards))
    answered = _answered(asked, cut(_counted(asked)), order)
    of_ids = asked.filter("shard < 0").select("block", "shard", F.col("own").alias("logs"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = dict(zip(right["shard"].to_pylist(), right["logs"], strict=True))
        ids = _table(answers.pop(-1).as_py()) if -1 in answers else None
        if ids is None:
            return schema.empty_table()
        others, own_grams, counts = _tallied(left["rows"], ids, order)
        every = np.concatenate([others, own_grams])
        table = np.full((3, len(every)), np.nan, "<f4")
        at_others, at_own = _shard_of(others, shards), _shard_of(own_grams, shards)
        for k in list(answers):
            values = np.frombuffer(answers.pop(k).as_py(), "<f4")
            mine = np.flatnonzero(at_own == k)
            placed = np.concatenate([np.flatnonzero(at_others == k), len(others) + mine])
            table[_ALL, placed] = values[: len(placed)]
            at = len(placed)
            for i in _FOLDS:
                held = len(others) + mine[counts[i][mine] > 0]
                table[i, held] = values[at : at + len(held)]
                at += len(held)
        order_of = np.argsort(every)
        every, table = every[order_of], table[:, order_of]
        places = _Places(every)
        out = []
        for bundle in left["rows"]:
            rows = _table(bundle.as_py())
            good, trusted = _flags(rows, ids)
            n, nats, held = [], [], []
            for i, text in enumerate(rows["text"].to_pylist()):
                raw = _encoded(text)
                n.append(len(raw))
                at = places.of(codes_of(raw, order)) if raw else None
                nats.append(-float(table[_ALL, at].mean(dtype=float)) if raw else None)
                # Row k of the table has what the other fold says of the texts of fold k.
                fold = _fold(raw) if trusted[i] else _ALL
                held.append(-float(table[fold, at].mean(dtype=float)) if raw and good[i] else None)
            columns = [*(rows[c] for c in own), pa.array(n, pa.int64()), pa.array(nats, pa.float64()), pa.array(held, pa.float64())]
            out.append(pa.Table.from_arrays(columns, names=[*own, "n_bytes", "nats", "held"]))
        return pa.concat_tables(out) if out else schema.empty_table()

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    result = f"{kinds}n_bytes long, nats double, held double"
    schema = to_arrow_schema(docs.sparkSession.createDataFrame([], result).schema)
    right = answered.unionByName(of_ids)  # one row per shard and block
    return dealt.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(score, result)


def thresholds(trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): the quantile of nats per language, and under `lang` "*" of all.

    Exact on a grid of BIN nats: rows are counted per grid step, so nothing but counts is
    ordered. Languages with less than MIN_TRUSTED texts have no row.
    """
    step = F.floor(F.col("nats") / BIN).alias("step")
    texts = trusted.filter(F.col("nats").isNotNull())
    named = texts.select(F.coalesce("lang", F.lit("")).alias("lang"), step)
    steps = named.unionByName(texts.select(F.lit("*").alias("lang"), step))
    bins = steps.groupBy("lang", "step").count()
    # The running sum goes by stretches of steps, so no language is one task.
    totals = bins.groupBy("lang").agg(F.sum("count").alias("total"))
    ranked = running(bins, {"upto": ("count", "sum")}, keys=("lang",), idx="step").join(totals, "lang")
    enough = (F.col("upto") >= quantile * F.col("total")) & (
        (F.col("total") >= MIN_TRUSTED) | (F.col("lang") == "*")
    )
    return ranked.filter(enough).groupBy("lang").agg(((F.min("step") + 1) * BIN).alias("limit"))


def _looked_up(rows: DataFrame, limits: DataFrame, name: str) -> DataFrame:
    """`rows` with the limit of their language as `name`, or that of all where it has none."""
    whole = limits.filter("lang = '*'").first()
    # A language can hold nearly all rows, so each is looked up in LANGUAGE_PARTS parts.
    part = F.explode(F.sequence(F.lit(0), F.lit(LANGUAGE_PARTS - 1))).alias("_part")
    own = limits.filter("lang <> '*'").select(F.col("lang").alias("_of"), "limit", part)
    rows = rows.withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(LANGUAGE_PARTS)))
    wanted = (F.coalesce("lang", F.lit("")) == F.col("_of")) & (F.col("_at") == F.col("_part"))
    value = F.coalesce("limit", F.lit(whole["limit"] if whole else None).cast("double"))
    return rows.join(own, wanted, "left").withColumn(name, value).drop("_of", "_part", "_at", "limit")


def _judged(docs: DataFrame, labels: DataFrame, order: int) -> DataFrame:
    """The columns of `docs` (doc_id, lang, ..., text) but the text, with n_bytes, nats, top (the
    limit in nats) and kept.

    The mean over n bytes scatters with 1 / sqrt(n): a limit is the median of a language's held
    texts and, over sqrt(n), the quantile of what they exceed it by, times sqrt(n).
    """
    scored = cut(perplexities(docs, labels, order))
    held = scored.filter("held is not null").select("lang", "n_bytes", F.col("held").alias("nats"))
    centres = cut(thresholds(held, 0.5))
    beyond = (F.col("nats") - F.col("_centre")) * F.sqrt("n_bytes")
    widths = cut(thresholds(_looked_up(held, centres, "_centre").select("lang", beyond.alias("nats"))))
    rows = _looked_up(_looked_up(scored, centres, "_centre"), widths, "_width")
    known = F.col("nats").isNotNull()
    top = F.col("_centre") + F.col("_width") / F.sqrt("n_bytes")
    passed = F.coalesce(F.col("nats") <= F.col("top"), F.lit(True))
    return (
        rows.withColumn("top", F.when(known, top))
        .withColumn("kept", known & passed)
        .drop("_centre", "_width", "held")
    )


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every row of `docs`.

    `labels` (doc_id, quality, toxic) says which texts are trusted: quality 1, not toxic. A text
    is kept if its perplexity per byte does not exceed the threshold of its language (NULL is a
    language; those with few trusted texts use the quantile of all). Texts without a byte have
    no perplexity and are rejected; without any trusted text nothing else is. Repeated rows are
    scored each, and count as often in the model if their doc_id is trusted.
    """
    return _judged(docs.select("doc_id", "lang", "text"), labels, order).select(
        "doc_id",
        "lang",
        "n_bytes",
        F.round(F.exp("nats"), 6).alias("perplexity"),
        F.round(F.exp("top"), 6).alias("threshold"),
        "kept",
    )


def keep(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    A verdict depends on language and text alone, so the rejected rows are those whose language,
    text length and two hashes of the text (96 bits) are those of a rejected one. Columns may
    have any names; their values are those of `docs`.
    """
    text = F.coalesce("text", F.lit(""))
    hashes = (F.xxhash64(text), F.hash(text), F.octet_length(text))
    keys = {free_name(docs, f"_key_{i}"): h for i, h in enumerate(hashes)}
    lang = free_name(docs, "_key_lang")
    rows = docs.withColumns(keys | {lang: F.coalesce("lang", F.lit(""))})
    judged = _judged(rows.select("doc_id", "lang", *keys, "text"), labels, order)
    rejected = judged.filter(~F.col("kept")).select(F.coalesce("lang", F.lit("")).alias(lang), *keys)
    kept = rows.join(rejected.distinct(), [lang, *keys], "left_anti")
    return kept.select(*[quoted(c) for c in docs.columns])
