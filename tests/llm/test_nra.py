import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitecast.llm import nra

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, k=50):
    """Every document scored in full."""
    tallies = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    tallies = [(d, c) for d, c in tallies if c]
    many, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c in tallies:
            m = 50 + 50 * sum(c.values()) * many // total
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, d is None, d, score))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(i, r + 1, s[2], s[3]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = []
    for d in range(900):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choices(words, weights, k=rng.randint(1, 60)))
        docs.append((d, text.upper() if d % 7 == 0 else text))
    docs += [(d + 2000, docs[d % 40][1]) for d in range(400)]  # copies: ties in great number
    docs += [(9000, None), (9001, ""), (9002, " .,"), (None, docs[3][1]), (7, docs[3][1]), (9003, "é" * 5000 + " w3 w299")]
    items = [(i, " ".join(rng.choices(words, weights, k=20))) for i in range(30)]
    items += [(100, docs[3][1]), (101, None), (102, ""), (103, "w299 w299 W298"), (103, "w297"), (None, "w5 w200"), (104, "zzz")]
    return docs, items


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize("item_bytes", [8 << 20, 200])
def test_equals_full_scoring(spark, corpus, monkeypatch, item_bytes):
    docs, items = corpus
    items = items if item_bytes > 200 else items[:8]
    monkeypatch.setattr(nra, "ITEM_BYTES", item_bytes)
    assert found(nra.search(*frames(spark, docs, items))) == plain(docs, items)


@pytest.mark.parametrize("block, first", [(1 << 21, 256), (700, 1), (40, 3)])
def test_blocks_and_reads_do_not_change_results(corpus, monkeypatch, block, first):
    import pyarrow as pa

    docs, items = corpus
    monkeypatch.setattr(nra, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(nra, "FIRST_READS", first)
    items = [(i, t) for i, t in items if t and i is not None and i < 100]
    queries = [sorted(set(nra.terms_of(t.encode()))) for _, t in items]
    known = {t: i for i, t in enumerate(sorted({t for q in queries for t in q}))}
    tallies = [(d, Counter(nra.terms_of((t or "").encode()))) for d, t in docs]
    tallies = [(d, c) for d, c in tallies if c]
    many, total = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) for t in known], np.int64)
    batch = pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([d for d, _ in tallies], pa.int64()),
            "n": pa.array([sum(c.values()) for _, c in tallies], pa.int64()),
            "terms": pa.array([[known[t] for t in c if t in known] for _, c in tallies], pa.list_(pa.int32())),
            "tfs": pa.array([[c[t] for t in c if t in known] for _, c in tallies], pa.list_(pa.int32())),
        }
    )
    asked = [np.array([known[t] for t in q], np.int64) for q in queries]
    got = []
    for part in nra._search(iter([batch.slice(0, 500), batch.slice(500)]), asked, weights, many, total, 50):
        rows = part.to_pylist()
        got += [(items[r["item"]][0], n + 1, r["doc_id"], r["score"]) for n, r in enumerate(rows)]
    assert sorted(got, key=str) == plain(docs, items)


def test_terms():
    assert nra.terms_of("Straße-É ABC_d1\x00x\x7fy z".encode()) == [
        t.encode() for t in TERM.findall("Straße-É ABC_d1\x00x\x7fy z".translate(LOWER))
    ]
    assert nra.terms_of(None) == [] == nra.terms_of(b"")


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    assert nra.search(docs.limit(0), items).count() == 0
    assert nra.search(docs, items.limit(0)).count() == 0
    assert nra.search(docs, items.selectExpr("item_id", "CAST(NULL AS STRING) text")).count() == 0


def test_extra_columns(spark, corpus):
    docs, items = frames(spark, corpus[0][:200], corpus[1][:5])
    for name in ("item", "rank", "score", "n", "terms", "cell", "item_id", "raw"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
        if name != "item_id":
            items = items.selectExpr("*", f"'x' AS `{name}`")
    assert found(nra.search(docs, items)) == plain(corpus[0][:200], corpus[1][:5])
