"""Columns of the caller that have the names of the operators' own come back as they were."""

import random

import pytest
from pyspark.sql import functions as F

from sitecast.llm import kneser_ney, rules, simhash

NAMES = [
    *rules.STATS, "base_failed", "rejected_by", "kept", "KEPT_too", "_row", "_caller", "_caller_row", "fp", "fingerprint",
    "component_id", "class_fp", "_text", "_text_hash", "_id", "_key", "_kept_id", "_kept_hash", "_a", "_b", "_c", "_lang",
    "_w", "_l", "_g", "_s", "_p", "_key_0", "_key_1", "_key_2", "_key_lang", "n_bytes", "nats", "held", "top", "block", "_block", "shard", "limit", "a.b",
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("the", "of", "ran", "sel", "mor") for b in ("", "t", "an", "ing", "er", "is")]
    texts = [" ".join(rng.choices(words, k=80)) + "." for _ in range(30)]
    made = [(i, t, "en") for i, t in enumerate(texts)] + [(100, texts[0], "en"), (101, "x", None), (102, None, "en"), (103, "q9# " * 60, "en")]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    for i, name in enumerate(NAMES):
        df = df.withColumn(name, F.concat(F.lit(f"mine {i} "), F.col("doc_id").cast("string")))
    return df.cache()


def untouched(rows, kept):
    assert kept.columns == rows.columns
    whole = {r["doc_id"]: tuple(r) for r in rows.collect()}
    got = [tuple(r) for r in kept.collect()]
    assert got and all(r == whole[r[0]] for r in got)
    return {r[0] for r in got}


def test_rules(rows):
    kept = untouched(rows, rules.keep(rows))
    judged = rules.apply_rules(rows.select("doc_id", "text"))
    assert kept == {r["doc_id"] for r in judged.collect() if r["kept"]}


def test_near_duplicates(rows):
    kept = untouched(rows, simhash.keep_one(rows))
    assert 0 in kept and 100 not in kept
    assert kept == {r["component_id"] for r in simhash.near_duplicates(rows.select("doc_id", "text")).collect()}


def test_quality_classifier(spark, rows):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    kept = untouched(rows, kneser_ney.keep(rows, labels))
    judged = kneser_ney.classify(rows.select("doc_id", "lang", "text"), labels)
    assert kept == {r["doc_id"] for r in judged.collect() if r["kept"]} and 102 not in kept
