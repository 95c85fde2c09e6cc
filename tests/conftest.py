import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("sitecast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def series(spark):
    """Three gridded sites of 300, 116 and 115 rows with a repeatable pattern of gaps."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for site, n in ((1, 300), (2, 116), (3, 115)):
        for i in range(n):
            y = None if rng.random() < 0.3 else round(float(rng.normal(5, 2)), 3)
            rows.append((site, i, n, y))
    df = spark.createDataFrame(rows, "campus_key int, row_idx bigint, n_rows bigint, SolarGeneration double")
    return df.cache()


@pytest.fixture(scope="session")
def plain(series):
    """The same series as {site: [values]}."""
    out = {}
    for r in sorted(series.collect(), key=lambda r: (r.campus_key, r.row_idx)):
        out.setdefault(r.campus_key, []).append(r.SolarGeneration)
    return out
