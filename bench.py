"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from sitecast.plans.queries import QUERIES
from sitecast.session import build

HEADLINE = [
    "grid_readings",
    "asof_weather",
    "scaled_readings",
    "sequence_index",
    "encoder_window_summary",
    "sequence_export",
    "segments_reference",
    "ar1_coefficients",
    "forecast_ar",
    "gap_fill_reference",
    "gap_fill_aligned",
    "scheduled_mix",
    "validation_modes",
    "blended_loss",
    "cross_site_scores",
    "metric_stall",
    "evaluation_report",
    "stats_table",
    "arx_forecast",
    "refine_history",
    "joint_forecast",
    "tree_forecast",
    "incremental_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    )
    spark = build(builder)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("grid_readings")  # starts the JVM's machinery
    seconds = {name: run(name) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
