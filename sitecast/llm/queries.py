"""The registered queries of this subpackage."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitecast.llm import (
    chat,
    decontaminate,
    hosts,
    huffman,
    kneser_ney,
    licences,
    nra,
    packing,
    pii,
    rules,
    runs,
    shards,
    simhash,
)
from sitecast.llm.common import shared_path, table, words_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

URL_RULES = [
    hosts.Rule("allow", "org/"),
    hosts.Rule("block", "example.org/es/"),
    hosts.Rule("block", "example.org/en/1"),
    hosts.Rule("allow", "com/fr/"),
    hosts.Rule("block", "com/de/"),
]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *rules.STATS, "base_failed", "kept")


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = hosts.with_outcome(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return hosts.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, benchmark)


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
    )
    own = spark.createDataFrame(
        [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema
    )
    return chat.conversation_digests(chat.expand_replies(rows.unionByName(own)))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return kneser_ney.classify(docs, labels)


@query
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    huffman.write_ids(table(spark, sf_dir, "documents"), TOKENIZER, path)
    return huffman.read_digests(spark, path)


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def _with_repeats(docs: DataFrame) -> DataFrame:
    """Documents whose doc_id's checksum ends in 0 repeat p words from word a on to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("h div 10")
    words = F.when(F.col("h") % 10 == 0, words_of(F.col("text")))
    cut = docs.select("doc_id", "text", h.alias("h")).select("doc_id", "text", g.alias("g"), words.alias("words"))
    n = F.size("words")
    a = F.pmod("g", F.greatest(n, F.lit(1))).cast("int").alias("a")
    cut = cut.select("doc_id", "text", "g", "words", a)
    p = (1 + F.expr("(size(words) - a) div (3 + g % 8)")).cast("int").alias("p")
    cut = cut.select("doc_id", "text", "words", "a", p)

    def source(i):
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))

    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", source(i)))
    changed = F.coalesce(n, F.lit(0)) > 0
    return cut.select("doc_id", F.when(changed, F.array_join(places, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(_with_repeats(table(spark, sf_dir, "documents"))))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
