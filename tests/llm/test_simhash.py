import re

import numpy as np
import pytest
import xxhash

from sitecast.llm import simhash
from sitecast.llm.components import components
from sitecast.llm.common import table
from tests.conftest import DATA


def fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, bits=2):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    members = {}
    for i in range(len(ids)):
        members.setdefault(find(i), []).append(ids[i])
    return {i: min(m) for m in members.values() for i in m}


def test_fingerprints_match_the_definition():
    for text in [None, "", " \n", "One", "one TWO", "Über ÄB c\td\x0be f", "a b c " * 50, "x y z w"]:
        assert simhash.fingerprint(text) == fingerprint(text)


@pytest.mark.parametrize("limit", [512, 3])
def test_classes_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIST_LENGTH", limit)
    docs = table(spark, DATA, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    want = classes([r["doc_id"] for r in rows], prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {
        r["doc_id"]: f"{p:016x}" for r, p in zip(rows, prints, strict=True)
    }


@pytest.mark.parametrize("limit", [512, 4])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, limit):
    """A third in one dense cloud, a chain of single flips, and fingerprints of their own."""
    monkeypatch.setattr(simhash, "LIST_LENGTH", limit)
    rng = np.random.default_rng(7)
    cloud = {0xABCDEF0123456789 ^ sum(1 << int(b) for b in rng.choice(64, 4)) for _ in range(120)}
    chain, at = [], 0x0F0F0F0F00000000
    for b in rng.permutation(64)[:60]:
        at ^= 1 << int(b)
        chain.append(at)
    prints = sorted({*cloud, *chain, *(int(x) for x in rng.integers(0, 1 << 63, 200))})
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    assert {x: found.get(x, x) for x in signed} == classes(signed, prints)


def test_empty_texts_null_ids_and_repeats(spark, docs):
    rows = [(5, ""), (3, None), (None, ""), (9, "some words here now"), (9, "some words here now"), (None, "alone in the world")]
    frame = docs(rows, extra=True)
    got = simhash.near_duplicates(frame).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 3), (3, 3), (5, 3), (9, 9), (9, 9)]
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [
        (0, "alone in the world"), (3, ""), (9, "some words here now"),
    ]
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0
