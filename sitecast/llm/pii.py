"""Personal data by weak supervision.

Base spans come from fixed patterns and stay. Looser patterns give further candidates (addresses
written with "(at)", numbers with other separators, six-part addresses). Labelers of three sorts
vote yes, no or nothing on every candidate, base ones included: patterns and check digits,
gazetteers (domain endings, issuer prefixes, calling codes), and the words and characters around.
Expectation-maximisation over the counts of all vote patterns of all documents estimates how
reliable each labeler is for each kind and how likely each pattern is personal data. Those
likelihoods train a logistic span classifier on features of the span; candidates outside base
spans that it accepts are added.
"""

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitecast.llm.common import ship, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# The base patterns, each up to what its own filter drops.
EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP_PATTERN = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD_PATTERN = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE_PATTERN = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOOSE_DOMAIN = re.compile(
    r"(?:@|[ ]?[(\[{]at[)\]}][ ]?)[A-Za-z0-9-]+(?:(?:\.|[ ]?[(\[{]dot[)\]}][ ]?)[A-Za-z0-9-]+)*", re.I
)
LOOSE_IP = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ./_\xa0-]{0,2}[0-9]){12,18}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+(])(?:\+|\()?[0-9][0-9 ()./\xa0-]{5,24}[0-9](?![0-9])")

# Gazetteers.
ENDINGS = {"com", "org", "net", "edu", "gov", "info", "biz", "io", "eu", "de", "fr", "es", "uk", "it", "nl", "us"}
ISSUERS = ("34", "35", "36", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "39", "4", "5", "6", "7", "8", "9")
CUES = (
    {"mail", "email", "e-mail", "contact", "write", "address", "correo", "courriel"},
    {"ip", "host", "server", "address", "client", "login"},
    {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta", "payment"},
    {"phone", "tel", "call", "mobile", "fax", "telefon", "contact", "teléfono", "téléphone"},
)
OTHER_CUES = {"version", "isbn", "order", "invoice", "page", "price", "build", "serial", "section", "release", "total"}

BEFORE = 40  # characters in front of a span that count as its context
YES, NO = 1, 2  # a vote; 0 is none
# Number of values of a span's features: separators, length, first character, check, words in
# front, letters beside it, marks beside it, gazetteer.
SIZES = (8, 10, 3, 3, 3, 2, 2, 3)
LABELERS = 6
ROUNDS, SMOOTH, RIDGE, ACCEPT = 100, 1.0, 1.0, 0.5
SPAN = "struct<start: int, end: int, kind: int>"
CANDIDATE = "struct<start: int, end: int, kind: int, votes: int, code: int, free: boolean>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _parts_fit(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _emails(text: str, domain: re.Pattern) -> Iterator[Span]:
    """Leftmost matches of local part and domain, found from the sign between them, so that a
    long stretch without one costs its length once."""
    last, after = 0, 0
    for m in domain.finditer(text):
        at = m.start()
        seg = text[max(last, after) : at]
        start = at - (len(seg) - len(seg.rstrip(EMAIL_LOCAL)))
        if start < at:
            yield start, m.end(), EMAIL
            last = m.end()
        after = at + 1


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind; places count code points."""
    out = list(_emails(text, EMAIL_DOMAIN)) if "@" in text else []
    for m in IP_PATTERN.finditer(text):
        if _parts_fit(m[0]):
            out.append((m.start(), m.end(), IP))
    for m in CARD_PATTERN.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), CARD))
    if "+" in text:
        for m in PHONE_PATTERN.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), PHONE))
    return sorted(out, key=lambda s: (s[0], s[2]))


def loose_spans(text: str) -> list[Span]:
    out = []
    if "@" in text or "at" in text.lower():
        out += _emails(text, LOOSE_DOMAIN)
    out += [(m.start(), m.end(), IP) for m in IP_PATTERN.finditer(text)]
    if ":" in text:
        out += [(m.start(), m.end(), IP) for m in LOOSE_IP.finditer(text)]
    out += [(m.start(), m.end(), CARD) for m in LOOSE_CARD.finditer(text)]
    for m in LOOSE_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), m.end(), PHONE))
    return out


def _gazetteer(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        return YES if re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]} "))[-1].lower() in ENDINGS else 0
    if kind == IP:
        first = span.split(".")[0]
        return YES if first.isdigit() and 1 <= int(first[:4]) <= 223 else 0
    if kind == CARD:
        return YES if digits.startswith(ISSUERS) else NO
    lead = span.lstrip("+(")
    return YES if span[0] == "+" and lead.startswith(CALLING) else 0 if span[0] in "+(0" else NO


def _check(kind: int, span: str, digits: str) -> int:
    if kind == EMAIL:
        good = re.search(r"(?:\.|dot[)\]}][ ]?)[A-Za-z]{2,}$", span) is not None
    elif kind == IP:
        try:
            ipaddress.ip_address(span)
            good = True
        except ValueError:
            good = False
    elif kind == CARD:
        good = 13 <= len(digits) <= 19 and luhn(digits)
    else:
        good = 10 <= len(digits) <= 15
    return YES if good else NO


def _style(span: str) -> int:
    """Which separators a span has: none, spaces, hyphens, points, brackets, others, mixed."""
    marks = {c for c in span if not c.isalnum()} - {"+", "@"}
    if not marks:
        return 0
    known = [" ", "-", ".", "(", ":", "/"]
    held = [i for i, c in enumerate(known) if c in marks]
    return held[0] + 1 if len(held) == 1 and len(marks) == 1 else 7


def _grown(n: int) -> int:
    return int(np.searchsorted([8, 10, 12, 13, 14, 16, 17, 20, 26], n, "right"))


def judged(text: str, span: Span, base: list[Span], starts: list[int], longest: int) -> tuple[int, int]:
    """Vote pattern and feature code of a candidate."""
    start, end, kind = span
    piece = text[start:end]
    digits = _digits(piece)
    left, right = text[start - 1 : start], text[end : end + 1]
    votes = [0] * LABELERS
    # Patterns: the fixed one of this kind, or another kind's that overlaps.
    i = bisect_left(starts, start - longest)
    while i < len(base) and base[i][0] < end:
        if base[i] == span:
            votes[0] = YES
        elif base[i][1] > start and votes[0] != YES:
            votes[0] = NO
        i += 1
    votes[1] = _gazetteer(kind, piece, digits)
    votes[2] = _check(kind, piece, digits)
    around = {w.strip(".,:;!?()[]\"'=").lower() for w in text[max(0, start - BEFORE) : start].split()}
    votes[3] = YES if around & CUES[kind] else NO if around & OTHER_CUES else 0
    glued = any(c and (c.isalnum() or c in "_=#") for c in (left, right))
    votes[4] = NO if glued else 0
    votes[5] = NO if left and left in "$€£%\"'" or right and right in "%€\"'" else 0
    pattern = 0
    for v in votes:
        pattern = 3 * pattern + v
    code = 0
    first = 0 if piece[0].isdigit() else 1 if piece[0] == "+" else 2
    values = (_style(piece), _grown(len(digits) or len(piece)), first, votes[2], votes[3], int(glued), int(votes[5] == NO), votes[1])
    for size, value in zip(SIZES, values, strict=True):
        code = size * code + value
    return pattern, code


def candidates(text: str) -> tuple[list[Span], list[tuple]]:
    """Base spans, and candidates with votes and features, `free` of base spans and each other."""
    base = base_spans(text)
    starts = [s[0] for s in base]
    longest = max((e - s for s, e, _ in base), default=0)
    known = set(base)
    out = [(*s, *judged(text, s, base, starts, longest), False) for s in base]
    loose = []
    for s in sorted(set(loose_spans(text)) - known):
        pattern, code = judged(text, s, base, starts, longest)
        balance, p = 0, pattern
        for _ in range(LABELERS):
            p, v = divmod(p, 3)
            balance += (v == YES) - (v == NO)
        clear = pattern // 3 ** (LABELERS - 1) == 0
        loose.append((s, pattern, code, balance, clear))
    # Of overlapping candidates the one with more votes goes on, then the first kind.
    i = 0
    while i < len(loose):
        j, end = i + 1, loose[i][0][1]
        while j < len(loose) and loose[j][0][0] < end:
            end = max(end, loose[j][0][1])
            j += 1
        taken: list[Span] = []
        for s, pattern, code, _, clear in sorted(loose[i:j], key=lambda c: (-c[3], c[0][2], c[0])):
            free = clear and all(s[1] <= t[0] or t[1] <= s[0] for t in taken[-64:])
            if free:
                taken.append(s)
            out.append((*s, pattern, code, free))
        i = j
    return base, out


def _spans(texts: Iterator[str | None]) -> tuple[pa.Array, pa.Array]:
    def listed(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
        flat = list(zip(*[x for r in rows for x in r])) or [[] for _ in fields]
        arrays = [pa.array(list(v), t) for v, (_, t) in zip(flat, fields)]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(arrays, names=[n for n, _ in fields]))

    bases, others = [], []
    for text in texts:
        base, more = candidates(text or "")
        bases.append(base)
        others.append(more)
    places = [(n, pa.int32()) for n in ("start", "end", "kind")]
    judged_fields = [*places, ("votes", pa.int32()), ("code", pa.int32()), ("free", pa.bool_())]
    return listed(bases, places), listed(others, judged_fields)


def estimate(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Likelihood of each vote pattern (rows of votes) to be personal data, by EM.

    A labeler has one distribution of yes, no and nothing on true spans and one on others; the
    start is the majority of votes.
    """
    weight = counts.astype(float)
    lead = (votes == YES).sum(1) - (votes == NO).sum(1)
    belief = 1 / (1 + np.exp(-1.5 * lead))
    cast = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    for _ in range(ROUNDS):
        rates = []
        for side in (belief, 1 - belief):
            mass = np.einsum("p,plv->lv", weight * side, cast) + SMOOTH
            rates.append(np.log(mass / mass.sum(1, keepdims=True)))
        share = (weight @ belief + SMOOTH) / (weight.sum() + 2 * SMOOTH)
        gain = np.einsum("plv,lv->p", cast, rates[0] - rates[1]) + np.log(share / (1 - share))
        new = 1 / (1 + np.exp(-np.clip(gain, -30, 30)))
        if np.abs(new - belief).max() < 1e-6:
            return new
        belief = new
    return belief


def unfold(codes: np.ndarray) -> np.ndarray:
    """Feature codes as indicator rows with a constant."""
    parts, rest = [], codes.astype(np.int64)
    for size in reversed(SIZES):
        parts.append(np.eye(size)[rest % size])
        rest = rest // size
    return np.hstack([np.ones((len(codes), 1)), *parts[::-1]])


def fit_classifier(codes: np.ndarray, belief: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of soft labels on span features, by Newton steps."""
    x = unfold(codes)
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - belief)) + ridge * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, slope)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def accepted(rows: list[tuple[int, int, int, int]]) -> list[int]:
    """Codes (with the kind in front) that the classifier accepts, from counts by kind, vote
    pattern and feature code; their number is bounded by the labelers and features alone."""
    out = []
    span = int(np.prod(SIZES))
    for kind in sorted({r[0] for r in rows}):
        mine = np.array([r[1:] for r in rows if r[0] == kind], np.int64)
        patterns, place = np.unique(mine[:, 0], return_inverse=True)
        counts = np.bincount(place, weights=mine[:, 2])
        votes = (patterns[:, None] // 3 ** np.arange(LABELERS - 1, -1, -1)) % 3
        belief = estimate(votes, counts)[place]
        weights = fit_classifier(mine[:, 1], belief, mine[:, 2].astype(float))
        codes = np.unique(mine[:, 1])
        out += (kind * span + codes[unfold(codes) @ weights > np.log(ACCEPT / (1 - ACCEPT))]).tolist()
    return out


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, base spans, candidates with votes and features."""
    ship(docs.sparkSession)
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("base", T._parse_datatype_string(f"array<{SPAN}>")),
            T.StructField("candidates", T._parse_datatype_string(f"array<{CANDIDATE}>")),
        ]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                base, more = _spans(t.as_py() for t in batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), base, more], names=schema.names)

    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(look, schema)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, `base` and all `spans` (start, end, kind), by start, then kind.

    Places are code points, ends exclusive; kinds are numbers into KINDS. Added spans overlap no
    base span and no other added one. A NULL or empty text has no spans; repeated rows and NULL
    doc_ids get a row each; an empty table gives an empty one. Only `doc_id` and `text` are
    read, so other columns may have any name. Reliabilities and classifier come from all
    documents: the driver sees counts by vote pattern and feature code, whose number no corpus
    grows beyond a constant.
    """
    seen = stored(marked(docs, text), "pii-candidates")
    each = seen.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.code").count()
    good = accepted([tuple(r) for r in each.collect()])
    span = int(np.prod(SIZES))
    codes = F.array(*[F.lit(g) for g in good]) if good else F.expr("array()").cast("array<int>")
    taken = F.filter(
        "candidates", lambda c: c["free"] & F.array_contains(codes, c["kind"] * span + c["code"])
    )
    added = F.transform(taken, lambda c: F.struct(c["start"], c["end"], c["kind"]))
    both = F.concat("base", added.cast(f"array<{SPAN}>"))
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    spans = F.transform(ordered, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return seen.select("doc_id", "base", spans.cast(f"array<{SPAN}>").alias("spans"))


def _written(spans: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(each, ",")


def digests(found: DataFrame) -> DataFrame:
    """Per row of `find`: base spans by kind, their checksum, and all spans as text."""
    counts = [
        F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS BIGINT)").alias(f"n_{name}")
        for k, name in enumerate(KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans")
    )
