"""Quality rules as a short-circuit cascade.

Each rule rejects texts. On a sample, the share that a rule rejects and the seconds that it
takes are measured; rules then run in order of rejections per second, and a text that one rule
rejects meets no later rule. The order decides the work, never the verdict.
"""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecast.llm.common import cut, free_name, words_of

SAMPLE_ROWS, SAMPLE_SEED, REPEATS = 2_000, 7, 2
MIN_SECONDS = 1e-3
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """`rejects` is a condition on the text column and the columns of `with_stats`."""

    name: str
    rejects: Column


def _kept_chars(text: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kind}]+", ""))


def _lines_like(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)))


def default_rules(text: str = "text") -> list[Rule]:
    """Rules of the usual kind for web text."""
    t, n = F.col(text), F.col("n_words")
    lines = F.greatest(F.size(F.split(t, "\n")), F.lit(1))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n),
        Rule("word_length", (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 12 * n)),
        Rule("repeated_lines", F.col("n_dup_lines") * 2 > lines),
        Rule("capitals", _kept_chars(t, r"\p{Lu}") > _kept_chars(t, r"\p{Ll}")),
        Rule("digits", _kept_chars(t, r"0-9") * 3 > F.length(t)),
        Rule("no_letters", _kept_chars(t, r"\p{L}") * 2 < F.col("word_chars")),
        Rule("bullets", _lines_like(t, r"^[\x20\t]*[-*•]") * 10 > 9 * lines),
        Rule("ellipses", _lines_like(t, r"(\.\.\.|…)[\x20\t]*$") * 10 > 3 * lines),
    ]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the columns of STATS and `base_failed`.

    n_repeat_words counts the words that lie in a window of three words found twice or more in
    the text. The windows of a text are hashed and sorted, so the cost grows as n log n with
    its length. A NULL text counts as empty: all zero, base_failed.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    # Positions of the windows whose hash has an equal neighbour in sorted order.
    repeated = F.sort_array(
        F.transform(
            F.filter(
                "_s",
                lambda x, i: F.coalesce(F.get("_s", i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("_s", i + 1)["h"] == x["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    distinct = F.size(F.array_distinct("_g")) == F.size("_g")
    pairs = F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    out = (
        docs.withColumn("_w", words_of(F.col(text)))
        .withColumn("_l", lines)
        .withColumn("_g", windows)
        .withColumn("_s", F.when(distinct, none).otherwise(F.sort_array(pairs)))
        .withColumn("_p", repeated)
        .withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
        .withColumn(
            "n_symbols",
            (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        )
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .drop("_w", "_l", "_g", "_s", "_p")
    )
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    return out.withColumn("base_failed", (n < 50) | (100 * repeats > 50 * n))


def measure(
    docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[dict]:
    """Per rule, on a random sample of about `sample_rows` rows: rejected share and seconds.

    The sample is a bounded number of rows by design: it sets the order of the rules only.
    Seconds are those of one task over the stored sample, less those of an empty condition.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / rows) if rows else 1.0
    sampled = cut(with_stats(docs.select(text).sample(share, SAMPLE_SEED), text))
    sample = sampled.filter(~F.col("base_failed")).coalesce(1)
    total = sample.count()

    def run(condition: Column) -> tuple[float, int]:
        took, hits = [], 0
        for _ in range(REPEATS):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), hits

    idle, _ = run(F.lit(False))
    found = []
    for rule in rules:
        seconds, hits = run(rule.rejects)
        cost = max(seconds - idle, MIN_SECONDS)
        rejected = hits / total if total else 0.0
        found.append({"rule": rule.name, "rejected": rejected, "seconds": cost})
    return found


def order(rules: list[Rule], measured: list[dict]) -> list[Rule]:
    """Rules by falling rejections per second; ties keep the given order."""
    rate = {m["rule"]: m["rejected"] / m["seconds"] for m in measured}
    return sorted(rules, key=lambda r: -rate[r.name])


def apply_rules(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    text: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """`docs` with STATS, `base_failed`, `rejected_by` (first rule of the cascade) and `kept`.

    The base conditions go first: a text that fails them meets no rule (`rejected_by` is NULL).
    NULL and empty texts fail them. Rows are judged one by one, so repeated rows get equal
    verdicts; columns of `docs` with the names of new ones are replaced; an empty table gives
    an empty one.
    """
    rules = default_rules(text) if rules is None else rules
    docs = docs.drop(*STATS, "base_failed", "rejected_by", "kept")
    stats = with_stats(docs, text)
    ordered = order(rules, measure(docs, rules, text, sample_rows))
    first = F.when(F.col("base_failed"), F.lit(None).cast("string"))
    for rule in ordered:
        first = first.when(rule.rejects, rule.name)
    judged = stats.withColumn("rejected_by", first)
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())


def keep(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`, their values untouched.

    The caller's columns travel as one, so those with the names of new ones come back as they
    were; rules see the new ones. The row number keeps the optimiser from pushing the condition
    below the steps it is built of, where each would be written out, and computed, as often as
    it is used.
    """
    own = free_name(docs, "_caller")
    row = free_name(docs, "_caller_row")
    judged = apply_rules(docs.select("*", F.struct("*").alias(own)), rules, text)
    judged = judged.withColumn(row, F.monotonically_increasing_id())
    passed = judged.filter(F.col("kept") & (F.col(row) >= 0))
    return passed.select(*[F.col(own)[c].alias(c) for c in docs.columns])
