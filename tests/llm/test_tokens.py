import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sitecast.llm import huffman, packing
from sitecast.llm.common import shared_path
from sitecast.llm.queries import TOKENIZER
from sitecast.llm.tokens import encode_texts

HARD = [
    None, "", " ", "  ", "a", " a", "a  b", "a   b", "a.. b", "a,. b", "a., b", "a!. B", "a.\nB. C, d", "x.\n y",
    "\n\n\nx", "x \n", "it's, it's.", "\x01\x02", "é, è.", "<|endoftext|> a", "hello <|endoftext|> x", "a, b<|endoftext|>. c", "<|endoftext|><|endoftext", "1. 2, 3", "a\u2028 b", "\x1c a. b", "z" * 300 + ". a",
    "., é%", "..", ",.", "\n.,", ".\n.", "x\n", "\n a", "a \nb", "a\n\tb", " \ta", "Ж. ſ, ƀ", "漢, a", "a1 1a 7. ²",
]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(TOKENIZER)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


@pytest.fixture(scope="module")
def texts():
    random.seed(8)
    some = ["word", "Word", " ", ". ", ", ", "\n", ".\n", ".", ",", "é", "7", "!", "'s", "\t", "  ", "\u00a0", "%"]
    return HARD + ["".join(random.choices(some, k=random.randint(0, 40))) for _ in range(1500)]


def test_ids_are_those_of_the_whole_text(texts, whole):
    for text, ids in zip(texts, encode_texts(TOKENIZER, texts), strict=True):
        assert ids.tolist() == whole(text).tolist(), repr(text)


def test_files_give_back_every_document_in_order(spark, docs, texts, whole, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 500)
    rows = [(i * 7 % 4001, t) for i, t in enumerate(texts)] + [(None, "n"), (3, "again"), (3, "again")]
    path = shared_path(spark, "t")
    huffman.write_ids(docs(rows, extra=True), TOKENIZER, path)
    got = sorted(huffman.read_documents(spark, path).collect(), key=lambda r: r["start"])
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert keys == sorted(-1 if i is None else i for i, _ in rows)
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    want = Counter((i, whole(t).astype("<u2").tobytes()) for i, t in rows)
    assert want == Counter((r["doc_id"], bytes(r["ids"])) for r in got)
    crc = {(r["start"], r["ids_crc32"]) for r in huffman.read_digests(spark, path).collect()}
    assert crc == {(r["start"], zlib.crc32(np.frombuffer(r["ids"], "<u2").astype("<u4").tobytes())) for r in got}


def test_empty_table_gives_empty_files(spark, docs):
    path = shared_path(spark, "t")
    huffman.write_ids(docs([]), TOKENIZER, path)
    assert huffman.read_digests(spark, path).count() == 0
    assert packing.pack(docs([]), TOKENIZER).count() == 0


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(5)
    for n in (2, 3, 50, 400):
        counts = rng.integers(1, 10_000, n)
        heap = [(int(c), i, 0) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        cost, serial = 0, n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], serial, 0))
            serial += 1
        assert (huffman.code_lengths(counts, 30) * counts).sum() == cost
    steep = np.array([2**i for i in range(30)])
    lengths = huffman.code_lengths(steep, 8)
    assert lengths.max() == 8 and (2.0 ** -lengths.astype(float)).sum() <= 1


def test_any_checkpoint_can_be_decoded():
    rng = np.random.default_rng(6)
    ids = (rng.zipf(1.3, 5000) % 3000).astype(np.uint16)
    book = huffman.Codebook(huffman.code_lengths(np.bincount(ids, minlength=1 << 16)))
    for n in (0, 1, 127, 128, 129, 5000):
        payload, marks = huffman.encode_block(ids[:n], book.codes(), book.lengths)
        assert (huffman.decode_block(payload, marks, n, book.table()) == ids[:n]).all()


def brute_bins(sizes, capacity):
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
            go(i + 1, [r - sizes[i] if j == k else r for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best[0]


def test_dominance_keeps_an_optimal_packing():
    rng = np.random.default_rng(9)
    for _ in range(120):
        sizes = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
        left = Counter(sizes)
        fixed = packing.reduce_by_dominance(left, 20)
        used = sum(t for _, t in fixed)
        assert all(sum(s) <= 20 for s, _ in fixed)
        rest = sorted(left.elements(), reverse=True)
        assert used + brute_bins(rest, 20) == brute_bins(sizes, 20)


def test_packing_places_every_piece_once(spark, docs, whole):
    random.seed(2)
    rows = [(i, " ".join(random.choices(["alpha", "beta", "of", "x"], k=random.randint(0, 90)))) for i in range(400)]
    rows += [(500, "long " * 700), (501, None), (None, "n"), (7, "twice"), (7, "twice")]
    got = packing.pack(docs(rows, extra=True), TOKENIZER, 64).collect()
    by_sequence, tokens = {}, Counter()
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        tokens[r["doc_id"]] += r["length"]
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    want = Counter()
    for i, t in rows:
        want[i] += len(whole(t))
    assert tokens == want
    assert len(by_sequence) <= 1.01 * -(-sum(tokens.values()) // 64) + 1
    ids = whole("long " * 700)
    for r in got:
        if r["doc_id"] == 500:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            assert r["length"] == 64 or r["piece"] == 0
