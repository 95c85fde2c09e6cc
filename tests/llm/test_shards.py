import zlib
from collections import Counter, defaultdict

import numpy as np

from sitecast.llm import shards


def check(rows, got):
    texts, by_shard, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert want == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got)
    text_of = {(r["size"], r["text_crc32"]): None for r in got}
    for r in got:
        texts[(r["size"], r["text_crc32"])].add(r["shard"])
        by_shard[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert text_of and all(len(s) == 1 for (size, _), s in texts.items() if size > 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [by_shard[i] for i in range(shards.SHARDS)]


def test_shards_are_near_equal_and_keep_groups(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, "x" * int(rng.integers(0, 400)) + str(i % 700)) for i in range(2000)]
    rows += [(None, None), (None, None), (5000, "")]
    sizes = check(rows, shards.shard_documents(docs(rows, extra=True)).collect())
    assert max(sizes) - min(sizes) <= 0.02 * np.mean(sizes)


def test_a_third_of_all_rows_is_one_group(spark, docs):
    rows = [(i, f"text {i}") for i in range(600)] + [(1000 + i, "same text") for i in range(300)]
    sizes = sorted(check(rows, shards.shard_documents(docs(rows)).collect()))
    assert sizes[-1] == 300 * 10
    assert sizes[-2] <= 360  # an equal share of the rest, 352.7, and less than one row
    assert shards.shard_documents(docs([])).count() == 0


def test_tree_finds_the_tightest_bin():
    rng = np.random.default_rng(2)
    tree, plain = shards.CapacityTree(), []
    for i in range(4000):
        size = int(rng.integers(1, 1000))
        if rng.random() < 0.6:
            tree.add((size, i))
            plain.append((size, i))
        else:
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take_tightest(size) == want
            if want:
                plain.remove(want)


def test_best_fit_decreasing_respects_the_capacity():
    sizes = np.random.default_rng(3).integers(1, 100, 3000)
    bins, used = shards.best_fit_decreasing(sizes, 100)
    loads = np.bincount(bins, sizes)
    assert loads.max() <= 100 and len(loads) == used
    assert used <= 1.02 * -(-sizes.sum() // 100) + 1


def test_bundles_are_few_for_any_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_GROUPS", 7)
    monkeypatch.setattr(shards, "FEWER_GROUPS", 1000)
    monkeypatch.setattr(shards, "MOST_BLOCKS", 3)
    groups = spark.range(2000).selectExpr("unhex(sha2(string(id), 256)) key", "1 + pmod(hash(id), 60) bytes")
    rows = shards.bundled(groups, 400, 2000).collect()
    assert {bytes(r["key"]): r["bytes"] for r in rows} == {bytes(r["key"]): r["bytes"] for r in groups.collect()}
    assert len(rows) == 2000
    sizes = Counter()
    for r in rows:
        sizes[r["block"], r["bin"]] += r["bytes"]
    assert max(sizes.values()) <= 400
    assert len(sizes) <= 2 * sum(sizes.values()) / 400 + 3
    assert sum(2 * s < 400 for s in sizes.values()) <= 3
    assert shards.bundled(groups.limit(0), 400, 0).count() == 0
