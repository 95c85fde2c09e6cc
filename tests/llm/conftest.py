import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang)."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en") for r in rows]
        out = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use themselves
            for name in ("shard", "fp", "kept", "n_words", "rank", "size", "verdict", "_row"):
                out = out.withColumn(name, F.lit("x"))
        return out

    return build
