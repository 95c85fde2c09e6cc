"""The whole pipeline on a small corpus against plain Python that shares no code with it but the
tokenizers library: dictionary Kneser-Ney with its limits, rules, all pairs of SimHashes, exact
containment, and packed pieces put together again."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from sitecast.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ORDER, BIN, LEAST = 6, 1e-3, 20


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return [" ".join(words)] if words else []
    return [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]


# ---- quality classifier ----------------------------------------------------------------


def discounts(counts):
    n = [sum(v == k for v in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    out = [0.0]
    for k, fixed in ((1, 0.5), (2, 0.75), (3, 0.9)):
        value = k - (k + 1) * y * n[k] / n[k - 1] if y and n[k - 1] and n[k] else fixed
        out.append(min(max(value, 0.05), k - 0.05))
    return out


class Model:
    """Interpolated modified Kneser-Ney over bytes, all orders in dictionaries."""

    def __init__(self, raws):
        grams = Counter()
        for raw in raws:
            wide = b"\n" * (ORDER - 1) + raw
            grams.update(wide[i : i + ORDER] for i in range(len(raw)))
        self.levels = {ORDER: grams}
        for m in range(ORDER - 1, 0, -1):
            self.levels[m] = Counter(g[1:] for g in self.levels[m + 1])
        self.cuts = {m: discounts(list(c.values())) for m, c in self.levels.items()}
        self.near = {m: defaultdict(list) for m in self.levels}
        for m, counts in self.levels.items():
            for g, n in counts.items():
                self.near[m][g[:-1]].append(n)
        self.known = {}

    def p(self, gram):
        if not gram:
            return 1 / 256
        if gram not in self.known:
            m, lower = len(gram), self.p(gram[1:])
            near = self.near[m].get(gram[:-1])
            if near:
                d, n, total = self.cuts[m], self.levels[m].get(gram, 0), sum(near)
                lower = (n - d[min(n, 3)]) / total + sum(d[min(k, 3)] for k in near) / total * lower
            self.known[gram] = lower
        return self.known[gram]

    def nats(self, raw):
        wide = b"\n" * (ORDER - 1) + raw
        return -sum(math.log(self.p(wide[i : i + ORDER])) for i in range(len(raw))) / len(raw)


def quantile(values, share):
    steps = sorted(math.floor(v / BIN) for v in values)
    return next((s + 1) * BIN for i, s in enumerate(steps) if i + 1 == len(steps) or (steps[i + 1] != s and i + 1 >= share * len(steps)))


def classified(docs, labels):
    good = {d for d, quality, _ in labels if quality == 1}
    trusted = {d for d, quality, toxic in labels if quality == 1 and toxic == 0}
    raws = [(d, (t or "").encode(), lang or "") for d, t, lang in docs]
    fold = lambda raw: zlib.crc32(raw) & 1
    whole = Model([r for d, r, _ in raws if d in trusted])
    halves = [Model([r for d, r, _ in raws if d in trusted and fold(r) == k]) for k in (0, 1)]
    held = defaultdict(list)
    for d, raw, lang in raws:
        if raw and d in good:
            nats = (halves[1 - fold(raw)] if d in trusted else whole).nats(raw)
            for name in (lang, "*"):
                held[name].append((nats, len(raw), lang))

    def limits(values, share):
        out = {name: quantile(v, share) for name, v in values.items() if name == "*" or len(v) >= LEAST}
        return lambda lang: out.get(lang, out["*"])

    centre = limits({name: [v for v, _, _ in rows] for name, rows in held.items()}, 0.5)
    beyond = {name: [(v - centre(lang)) * math.sqrt(n) for v, n, lang in rows] for name, rows in held.items()}
    width = limits(beyond, 0.99)
    kept = set()
    for d, raw, lang in raws:
        if raw and whole.nats(raw) <= centre(lang) + width(lang) / math.sqrt(len(raw)):
            kept.add(d)
    return kept


# ---- rules, near duplicates, benchmark ---------------------------------------------------


def passes(text):
    words, lines = WORD.findall(text or ""), (text or "").split("\n")
    n, chars = len(words), sum(map(len, words))
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    if n < 50 or 100 * len(repeated) > 50 * n:
        return False
    full = [x for x in lines if WORD.search(x)]
    of = lambda kind: sum(unicodedata.category(c).startswith(kind) for c in text)
    return not (
        sum(c in "#*$%&|<>" for c in text) * 10 > n
        or chars < 3 * n
        or chars > 12 * n
        or (len(full) - len(set(full))) * 2 > len(lines)
        or of("Lu") > of("Ll")
        or sum(c in "0123456789" for c in text) * 3 > len(text)
        or of("L") * 2 < chars
        or sum(bool(re.search(r"^[\x20\t]*[-*•]", x)) for x in lines) * 10 > 9 * len(lines)
        or sum(bool(re.search(r"(\.\.\.|…)[\x20\t]*$", x)) for x in lines) * 10 > 3 * len(lines)
    )


def simhash(text):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def firsts(docs):
    """The smallest id of every component of all near pairs."""
    prints = [(d, simhash(t)) for d, t, _ in docs]
    root = {d: d for d, _ in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, x) in enumerate(prints):
        for e, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {top(d) for d, _ in prints}


def leaked(text, items):
    mine = set(shingles(text, 5))
    return any(item and 10 * len(item & mine) >= 8 * len(item) for item in (set(shingles(t, 5)) for _, t in items))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    parts = ["the", "of", "in", "run", "sol", "mar", "ten", "ver", "dis", "pla", "kor", "el"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(400)]

    def prose(n=90):
        return " ".join(rng.choices(words, k=n)) + "."

    items = [(i, prose(18)) for i in range(5)] + [(9, None)]
    docs = [(i, prose(rng.randint(60, 140)), rng.choice(["en", "de"])) for i in range(70)]
    docs += [(100 + i, docs[i][1], docs[i][2]) for i in range(6)]  # exact copies
    docs += [(110 + i, docs[i][1][:-1] + "!", docs[i][2]) for i in range(10, 16)]  # nearly so
    docs += [(200 + i, prose(50) + " " + t + " " + prose(50), "en") for i, (_, t) in enumerate(items[:5])]
    docs += [(300, "qZ9#x " * 90, "en"), (301, "", "en"), (302, None, "en"), (303, prose(20), "en"), (304, prose(70), None)]
    docs += [(305, "the the of " * 40, "en"), (306, "7391 " * 80, "de"), (307, prose(800), "en")]
    docs += [(308, "".join(rng.choices("xqwzkj vb", k=700)), "de")]
    labels = [(i, 1, int(i % 17 == 3)) for i in range(50)] + [(300, 0, 0), (308, 0, 0), (999, 1, 0)]
    return docs, labels, items


def test_pipeline_equals_plain_python(spark, corpus, tmp_path):
    docs, labels, items = corpus
    rng = random.Random(1)
    shuffled = rng.sample(docs, len(docs))
    frame = spark.createDataFrame(shuffled, "doc_id long, text string, lang string")
    frame.selectExpr("*", "'s' AS source", "length(text) AS n_chars").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = classified(docs, labels)
    left = [d for d in docs if d[0] in kept and passes(d[1])]
    one = firsts(left)
    want = [d for d in left if d[0] in one and not leaked(d[1], items)]
    # Every stage has something to do, and something to keep.
    assert len(docs) > len(kept) > len(left) > len(one) > len(want) > 30

    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    whole = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for d, t, _ in want}
    assert {r["doc_id"] for r in rows} == set(whole)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    for d, mine in pieces.items():
        mine.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert [r["start"] for r in mine] == [sum(q["length"] for q in mine[:i]) for i in range(len(mine))]
        assert sum(r["length"] for r in mine) == len(whole[d])
        assert len(mine) == -(-len(whole[d]) // 1024) and all(r["length"] == 1024 for r in mine[1:])
    for placed in sequences.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 1024
    # Best fit leaves no two sequences that would fit into one.
    loads = sorted(sum(n for _, n in p) for p in sequences.values())
    assert len(loads) < 2 or loads[0] + loads[1] > 1024
