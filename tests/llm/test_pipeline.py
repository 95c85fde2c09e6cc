import corpus_pipeline
from sitecast.llm import decontaminate, kneser_ney, packing, rules, simhash
from sitecast.llm.common import table
from sitecast.llm.queries import TOKENIZER
from tests.conftest import DATA


def test_stages_keep_the_columns_and_their_decisions_take_effect(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    labels, benchmark = table(spark, DATA, "labels"), table(spark, DATA, "benchmark")
    want = {
        "quality_classifier": lambda d: {r["doc_id"] for r in kneser_ney.classify(d, labels).filter("kept").collect()},
        "quality_rules": lambda d: {r["doc_id"] for r in rules.apply_rules(d).select("doc_id", "kept").collect() if r["kept"]},
        "simhash_near_dedup": lambda d: {r["component_id"] for r in simhash.near_duplicates(d).collect()},
        "benchmark_decontamination": lambda d: {r["doc_id"] for r in d.collect()}
        - {r["doc_id"] for r in decontaminate.contaminated(d, benchmark).collect()},
    }
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) == want[name](docs)
        if name == "quality_classifier":
            assert good <= set(ids)
        docs = kept
    lengths = packing.token_pieces(docs, TOKENIZER).groupBy("doc_id").sum("length").collect()
    ran = corpus_pipeline.run(spark, DATA).groupBy("doc_id").sum("length").collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, lengths))
