import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitecast.llm import pii

# The contract's patterns, run as they stand.
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m, d: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m, d: 14 <= len(d) <= 19 and plain_luhn(d)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m, d: 10 <= len(d) <= 15),
)


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_base(text):
    out = []
    for k, (_, pattern, fits) in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            if fits(m[0], re.sub("[^0-9]", "", m[0])):
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


TEXTS = [
    "", "write to a.b+c@mail-1.example.com, or x@y", "a@b.c@d.e@f.g @h.i j@@k.l m@n..o p@q.r.",
    "at 10.0.0.1 and 256.1.1.1, 1.2.3.4.5.6.7.8, 001.002.003.004, 1.2.3.0004 1.2.3.00256",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 5500  0000 0000 0004; 4111111111111111-",
    "call +1 (266) 555-7228 or +49 30 1234567 or +1 2 3, ++44 20 7946 0958. 555 123 4567",
    "é€ + a@b.de 😀 +33 1 23 45 67 89 ü 8.8.8.8", "9" * 50 + " " + "1.2.3." * 30 + "4", "+" * 40 + "1" * 12,
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.- +1259()%é", max_size=60))
def test_base_equals_the_patterns_on_any_text(text):
    assert pii.base_spans(text) == plain_base(text)


def test_long_texts_take_linear_time():
    for unit in ("a", "1", "1.", "1 ", "@", "+1", "a@", "+ ", "(at)", "1:", "1-"):
        pii.candidates(unit * 200_000)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in spans)


def corpus(seed, n=1500):
    """Texts with planted spans: plain ones, loosely written ones and look-alikes."""
    rng = random.Random(seed)

    def digits(k):
        return "".join(rng.choices("0123456789", k=k))

    def card():
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if plain_luhn(body + c))

    def plant():
        kind = rng.choice(["email", "ip", "card", "phone", "loose email", "loose card", "bad ip", "bad card", "order"])
        name, c = "".join(rng.choices("abcdefgh", k=6)), card()
        four = [c[i : i + 4] for i in range(0, 16, 4)]
        return {
            "email": ("mail me at", f"{name}@host.example.com", 0),
            "ip": ("login from host", ".".join(str(rng.randint(1, 223)) for _ in range(4)), 1),
            "card": ("credit card", rng.choice(["", " ", "-"]).join(four), 2),
            "phone": ("call", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", 3),
            "loose email": ("mail me at", f"{name} (at) host (dot) com", 0),
            "loose card": ("credit card", ".".join(four), 2),
            "bad ip": ("release", f"{rng.randint(300, 999)}.{digits(1)}.{digits(2)}.7", None),
            "bad card": ("order", "9" + c[1:14] + str((int(c[14]) + 1) % 10) + c[15], None),
            "order": ("invoice", digits(9), None),
        }[kind]

    rows = []
    for i in range(n):
        words = [f"w{chr(97 + rng.randint(0, 25))}" for _ in range(rng.randint(3, 30))]
        cue, span, kind = plant()
        lead = " ".join(words) + f" {cue} "
        rows.append((i, f"{lead}{span} {' '.join(words)}", len(lead), len(lead) + len(span), kind))
    return rows


def test_planted_spans_are_found_and_look_alikes_are_not(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.find(docs).collect()}
    caught = [got[d] == [(s, e, k)] for d, _, s, e, k in rows if k is not None]
    clean = [got[d] == [] for d, _, _, _, k in rows if k is None]
    assert np.mean(caught) > 0.97 and np.mean(clean) > 0.97
    loose = [got[d] == [(s, e, k)] for d, t, s, e, k in rows if "(at)" in t]
    assert np.mean(loose) > 0.9


def test_edge_rows_and_digests(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)] + [(90, None), (None, TEXTS[1]), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("base", "spans", "candidates", "kind", "start", "code"):
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    got = pii.digests(pii.find(docs)).collect()
    assert len(got) == len(rows)
    want = sorted(
        (
            (d, *[sum(s[2] == k for s in base) for k in range(4)], hashlib.sha256(written(base).encode()).hexdigest())
            for d, base in ((d, plain_base(t or "")) for d, t in rows)
        ),
        key=str,
    )
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        base = {written([s]) for s in plain_base(dict(rows).get(r["doc_id"]) or "")} if r["doc_id"] is not None else set()
        assert base <= set(r["spans"].split(","))
    assert pii.digests(pii.find(docs.limit(0))).count() == 0


def test_reliable_labelers_outvote_a_bad_one():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.zeros((4000, pii.LABELERS), int)
    for i, right in enumerate((0.95, 0.9, 0.85, 0.55, 0.5, 0.5)):
        said = np.where(rng.random(4000) < right, truth, ~truth)
        votes[:, i] = np.where(rng.random(4000) < 0.2, 0, np.where(said, pii.YES, pii.NO))
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    belief = pii.estimate(patterns, counts)[place.ravel()]
    # What knowing the labelers' true reliabilities and the true share would give.
    sure = np.log(np.array([0.95, 0.9, 0.85, 0.55, 0.5, 0.5]) / (1 - np.array([0.95, 0.9, 0.85, 0.55, 0.5, 0.5])))
    best = ((votes == pii.YES) * sure - (votes == pii.NO) * sure).sum(1) + np.log(0.4 / 0.6)
    majority = (votes == pii.YES).sum(1) > (votes == pii.NO).sum(1)
    got = np.mean((belief > 0.5) == truth)
    assert got > np.mean((best > 0) == truth) - 0.01 and got > np.mean(majority == truth) + 0.02
