import random

from sitecast.llm import rules


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + d for i, w in enumerate(windows) if w in twice for d in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, docs):
    random.seed(4)
    texts = [" ".join(random.choices("abcd#", k=random.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(random.choices(["a b", "c", "", " "], k=9)) for _ in range(40)]
    texts += [None, "", " \x0b\x0c\r\t", "a\u00a0b \u2028c", "x " * 5000, "é😀 <|"]
    got = rules.with_stats(docs(list(enumerate(texts)), extra=True).drop("n_words")).collect()
    for row in got:
        assert tuple(row[c] for c in rules.STATS) == brute(texts[row["doc_id"]]), texts[row["doc_id"]]


PROSE = " ".join(f"word{i} here" for i in range(40))
JUNK = " ".join(f"Ab{i}%%%" for i in range(90))
SHOUT = " ".join(f"LOUD{chr(65 + i % 26)}{chr(65 + i % 7)}X" for i in range(90))


def test_verdicts_do_not_depend_on_the_order(spark, docs):
    rows = [(1, PROSE), (2, JUNK), (3, SHOUT), (4, None), (5, "short"), (1, PROSE)]
    got = {r["doc_id"]: r for r in rules.apply_rules(docs(rows, extra=True)).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4, 5)] == [True, False, False, False, False]
    assert got[2]["rejected_by"] in ("symbols", "no_letters")  # whichever the cascade asks first
    assert (got[3]["rejected_by"], got[5]["rejected_by"]) == ("capitals", None)
    kept = rules.keep(docs(rows, extra=True), rules.default_rules()[::-1])
    assert [r["doc_id"] for r in kept.collect()] == [1, 1]
    assert kept.columns == docs(rows, extra=True).columns
    assert rules.apply_rules(docs([])).count() == 0


def test_rules_are_ordered_by_rejections_per_second():
    found = rules.default_rules()[:3]
    measured = [
        {"rule": found[0].name, "rejected": 0.5, "seconds": 1.0},
        {"rule": found[1].name, "rejected": 0.1, "seconds": 0.01},
        {"rule": found[2].name, "rejected": 0.0, "seconds": 0.001},
    ]
    assert [r.name for r in rules.order(found, measured)] == [found[1].name, found[0].name, found[2].name]
