import math
import random
from collections import Counter

import numpy as np

from sitecast.llm import kneser_ney as kn
from sitecast.llm.common import table
from tests.conftest import DATA

LABELS = "doc_id long, quality int, toxic int"


def brute(texts):
    """p(c | a, b) of the definition, over dictionaries."""
    tri = Counter()
    for t in texts:
        raw = b"\n\n" + t.encode()
        tri.update(zip(raw, raw[1:], raw[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def discount(counts):
        d = kn.discounts(Counter(counts.values()))
        return lambda n: d[min(n, 3)]

    d3, d2, d1 = discount(tri), discount(bi), discount(uni)

    def p1(c):
        total = sum(uni.values())
        free = sum(map(d1, uni.values())) / total
        return (uni[c] - d1(uni[c])) / total + free / 256

    def p2(b, c):
        near = {k[1]: n for k, n in bi.items() if k[0] == b}
        if not near:
            return p1(c)
        total = sum(near.values())
        n = near.get(c, 0)
        return (n - d2(n)) / total + sum(map(d2, near.values())) / total * p1(c)

    def p3(a, b, c):
        near = {k[2]: n for k, n in tri.items() if k[:2] == (a, b)}
        if not near:
            return p2(b, c)
        total = sum(near.values())
        n = near.get(c, 0)
        return (n - d3(n)) / total + sum(map(d3, near.values())) / total * p2(b, c)

    return p3


def test_packed_trigrams_come_back():
    for text in [None, "", "a", "é" * 3, "ab" * 500, "".join(map(chr, range(1, 3000)))]:
        codes, counts = np.unique(kn.codes_of((text or "").encode(), 3), return_counts=True)
        again = kn.unpacked(kn.packed(codes, counts))
        assert (again[0] == codes).all() and (again[1] == counts).all()


def test_perplexity_is_that_of_the_definition(spark, docs):
    random.seed(1)
    made = ["".join(random.choices("abc d\né", k=random.randint(1, 40))) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(made)] + [(100, "never séen ZZ", "en"), (101, None, None), (102, "", "de")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(25, 0, 0), (26, 1, 1), (None, 1, 0)], LABELS)
    got = {r["doc_id"]: r for r in kn.classify(docs(rows), labels, 3).collect()}
    p = brute(made[:20])
    assert len(got) == len(rows)
    for i, text, _ in rows:
        raw = b"\n\n" + (text or "").encode()
        nats = [-math.log(p(*g)) for g in zip(raw, raw[1:], raw[2:])]
        if nats:
            assert math.isclose(got[i]["perplexity"], math.exp(np.mean(nats)), rel_tol=1e-5)
        else:
            assert got[i]["perplexity"] is None and not got[i]["kept"]


def test_every_context_sums_to_one():
    for a, b in ((97, 98), (10, 10), (200, 5)):
        p = brute(["ab ab abc", "aab\nbb"])
        assert math.isclose(sum(p(a, b, c) for c in range(256)), 1.0)


def test_thresholds_are_quantiles_of_each_language(spark):
    rows = [("en", i / 100) for i in range(100)] + [("de", 5.0)] * 30 + [("xx", 9.0), (None, 1.0)]
    got = {r["lang"]: r["limit"] for r in kn.thresholds(spark.createDataFrame(rows, "lang string, nats double"), 0.9).collect()}
    assert abs(got["en"] - 0.9) < 0.011 and abs(got["de"] - 5.0) < 0.01
    assert set(got) == {"en", "de", "*"}


def test_labelled_texts_are_told_apart(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    judged = kn.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    assert all(good) and sum(bad) < len(bad)


def test_edges(spark, docs):
    labels = spark.createDataFrame([], LABELS)
    rows = [(1, "some text"), (2, None), (1, "some text")]
    got = kn.classify(docs(rows), labels).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == [(1, True), (1, True), (2, False)]
    assert kn.classify(docs([]), labels).count() == 0
    frame = docs(rows, extra=True)
    kept = kn.keep(frame, labels)
    assert kept.columns == frame.columns and kept.count() == 2


def test_limits_come_from_held_out_texts(spark):
    folder = DATA.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    judged = kn.classify(docs, labels).join(labels, "doc_id").collect()
    bad = [r["kept"] for r in judged if r["quality"] == 0]
    good = [r["kept"] for r in judged if r["quality"] == 1]
    assert sum(bad) <= 0.04 * len(bad) and sum(good) >= 0.99 * len(good)


def brute_of(texts, order):
    """p of the last byte of an n-gram by the definition at any order, over dictionaries."""
    grams = Counter()
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        grams.update(raw[i : i + order] for i in range(len(raw) - order + 1))
    levels = {order: grams}
    for m in range(order - 1, 0, -1):
        levels[m] = Counter(k[1:] for k in levels[m + 1])
    cuts = {m: kn.discounts(Counter(c.values())) for m, c in levels.items()}

    def p(gram):
        if not gram:
            return 1 / 256
        m = len(gram)
        near = {k: n for k, n in levels[m].items() if k[:-1] == gram[:-1]}
        if not near:
            return p(gram[1:])
        n, d, total = near.get(gram, 0), cuts[m], sum(near.values())
        return (n - d[min(n, 3)]) / total + sum(d[min(k, 3)] for k in near.values()) / total * p(gram[1:])

    return p


def test_default_order_sees_six_bytes(spark, docs):
    assert kn.ORDER == 6
    random.seed(2)
    made = ["".join(random.choices("abc d\né", k=random.randint(1, 40))) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(made)] + [(100, "never séen ZZ", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS)
    got = {r["doc_id"]: r["perplexity"] for r in kn.classify(docs(rows), labels).collect()}
    p = brute_of(made[:20], 6)
    for i, text, _ in rows:
        raw = b"\n" * 5 + text.encode()
        nats = [-math.log(p(raw[k : k + 6])) for k in range(len(raw) - 5)]
        assert math.isclose(got[i], math.exp(np.mean(nats)), rel_tol=1e-5)
