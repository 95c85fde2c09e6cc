import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitecast.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """All runs by comparing every word with the one q before, for every q."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and (i, j - i + q) not in out:
                out[i, j - i + q] = q
            i = max(j, i) + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def got_runs(texts):
    codes = {}
    split = [[codes.setdefault(w, len(codes)) for w in t] for t in texts]
    doc, start, length, period = runs.find_runs(
        np.array([c for t in split for c in t], np.int64), np.array([len(t) for t in split], np.int64)
    )
    out = [[] for _ in texts]
    for d, *run in zip(doc.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append(tuple(run))
    return out


def examples(rng):
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 700, list("abab" * 3), list("abcabcabcab"), list("abcabcabcabc")]
    texts += [["a"] * 9 + ["b"] + ["a"] * 9, (["a"] * 7 + ["b"]) * 9, list("abaababaabaab" * 8)]
    for _ in range(150):
        texts.append(rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, 90)))
    for _ in range(100):
        unit = rng.choices("abcdefgh", k=rng.randint(1, 30))
        middle = unit * rng.randint(3, 9) + unit[: rng.randint(0, len(unit))]
        texts.append(rng.choices("abcdefgh", k=rng.randint(0, 20)) + middle + rng.choices("abcdefgh", k=rng.randint(0, 20)))
    return texts


@pytest.mark.parametrize("small, candidates", [(64, 1 << 20), (1, 50)])
def test_equals_brute_force(monkeypatch, small, candidates):
    monkeypatch.setattr(runs, "SMALL", small)
    monkeypatch.setattr(runs, "CANDIDATES", candidates)
    texts = examples(random.Random(small))
    assert got_runs(texts) == [plain_runs(t) for t in texts]
    for t in texts[:60]:
        assert got_runs([t]) == [plain_runs(t)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_equals_brute_force_on_any_words(texts):
    assert got_runs(texts) == [plain_runs(t) for t in texts]


def test_extensions():
    rng = np.random.default_rng(2)
    words = np.concatenate([[9], np.tile(rng.integers(0, 2, 7), 40), rng.integers(0, 2, 200), np.full(99, 1), [8]])
    grammar = runs.Grammar(words, 1)
    x, y = rng.integers(1, len(words) - 1, 400), rng.integers(1, len(words) - 1, 400)
    x, y = x[x != y], y[x != y]
    for back in (False, True):
        for a, b, got in zip(x, y, grammar.extension(x, y, back)):
            n, d = 0, -1 if back else 1
            while words[a + d * n] == words[b + d * n]:
                n += 1
            assert n == got


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n and doc_id is not None:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    return (
        doc_id,
        len(found),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
        hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest(),
    )


def test_query_equals_brute_force(spark, tmp_path):
    from sitecast.llm.queries import QUERIES

    rng = random.Random(8)
    sample = examples(rng)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(t)) for i, t in enumerate(sample * 2)]
    rows += [(5000, None), (5001, ""), (5002, " \x0b"), (None, "a " * 8), (None, None), (3, "x y \x1cz " * 7), (3, "é ß " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(d, t) for d, t in rows), key=str)


def test_long_text_empty_table_and_extra_columns(spark):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 9999)}" for _ in range(60_000)] + ["a", "b", "c"] * 30_000 + ["z"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "q")], "doc_id long, text string")
    for name in ("runs", "n_words", "collapsed", "best", "start", "raw"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(60_000, 90_000, 3)]
    assert got[1]["collapsed"] == " ".join(words[:60_003] + ["z"]) and got[2]["runs"] == []
    assert runs.digests(runs.periodic_runs(docs.limit(0))).count() == 0
