import random

from sitecast.llm import decontaminate as dc

ITEMS = "item_id long, text string"


def words(rng, n):
    return ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]


def test_planted_items_are_found_in_long_documents(spark, docs):
    rng = random.Random(3)
    items = [words(rng, rng.randint(6, 160)) for _ in range(60)]
    rows, want = [], set()
    for i, item in enumerate(items):
        body = words(rng, rng.choice([0, 10, 300, 6000]))
        at = rng.randint(0, len(body))
        rows.append((i, " ".join(body[:at] + item + body[at:]).upper()))
        want.add((i, i))
    rows += [(100 + i, " ".join(words(rng, 400))) for i in range(60)]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], ITEMS)
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs(rows, extra=True), benchmark).collect()}
    assert got == want
    kept = dc.without_contaminated(docs(rows, extra=True), benchmark)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(100, 160))
    assert kept.columns == docs(rows, extra=True).columns


def test_containment_limit_is_exact(spark, docs):
    rng = random.Random(4)
    item = words(rng, 54)  # 50 shingles
    rows = [(n, " ".join(words(rng, 20) + item[:n] + words(rng, 20))) for n in range(40, 50)]
    benchmark = spark.createDataFrame([(1, " ".join(item))], ITEMS)
    got = {r["doc_id"]: (r["n_shared"], r["n_item"]) for r in dc.contaminated(docs(rows), benchmark).collect()}
    assert got == {n: (n - 4, 50) for n in range(44, 50)}


def test_edges(spark, docs, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x a b"), (4, "one two three four five six")]
    items = [(1, None), (2, ""), (3, "A B"), (None, "one two three four five"), (5, "one two three four five")]
    benchmark = spark.createDataFrame(items, ITEMS)
    want = [(3, 3), (3, 3), (4, 0), (4, 5)]
    for per_pass in (1 << 20, 4):
        monkeypatch.setattr(dc.item_indexes, "__defaults__", (dc.WIDTH, dc.FUNCTIONS, dc.SEED, per_pass))
        got = dc.contaminated(docs(rows), benchmark).collect()
        assert sorted((r["doc_id"], r["item_id"] or 0) for r in got) == want
        assert dc.without_contaminated(docs(rows), benchmark).count() == 3
    none = spark.createDataFrame([], ITEMS)
    assert dc.contaminated(docs(rows), none).count() == 0
    assert dc.without_contaminated(docs(rows), none).count() == 6
    assert dc.contaminated(docs([]), benchmark).count() == 0


def test_short_items_are_never_missed():
    """Items of one to seven shingles in documents of every length near theirs, and longer."""
    rng = random.Random(9)
    items = [words(rng, 5 + i % 7) for i in range(1400)]
    index = dc.ItemIndex([(i, " ".join(x)) for i, x in enumerate(items)], dc.WIDTH, dc.FUNCTIONS, dc.SEED)
    texts = []
    for item in items:
        body = words(rng, rng.choice([0, 1, 9, 120, 125]))
        at = rng.randint(0, len(body))
        texts.append(" ".join(body[:at] + item + body[at:]))
    found = {(at, item) for at, item, _, _ in index.contained(texts, dc.THRESHOLD)}
    assert found == {(i, i) for i in range(len(items))}


def test_recall_of_items_scattered_over_a_document():
    """Items whose sentences lie apart are not promised; most are found, none wrongly."""
    rng = random.Random(10)
    items = [words(rng, rng.randint(30, 60)) for _ in range(300)]
    index = dc.ItemIndex([(i, " ".join(x)) for i, x in enumerate(items)], dc.WIDTH, dc.FUNCTIONS, dc.SEED)
    texts = []
    for item in items:
        half = len(item) // 2
        texts.append(" ".join(words(rng, 40) + item[:half] + words(rng, 60) + item[half:] + words(rng, 40)))
    found = {(at, item) for at, item, _, _ in index.contained(texts, dc.THRESHOLD)}
    exact = set()
    for at, text in enumerate(texts):
        whole = set(dc.shingle_hashes(text, dc.WIDTH).tolist())
        mine = set(dc.shingle_hashes(" ".join(items[at]), dc.WIDTH).tolist())
        if len(mine & whole) >= dc.THRESHOLD * len(mine):
            exact.add((at, at))
    assert found <= exact and len(exact) > 200
    print("recall of halved items", len(found) / len(exact))
    assert len(found) >= 0.9 * len(exact)
