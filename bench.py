"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS set the data folder and the cores. BENCH_QUERIES names other
queries, separated by commas.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from logveil.given.queries import QUERIES  # noqa: E402
from logveil.given.records import landed_log  # noqa: E402

HEADLINE = [
    "suspicious_topn",
    "category_profile",
    "existing_detections",
    "detection_rate_72h",
    "normalized_tokens",
    "shingle_sets",
    "dedup_jaccard",
    "dedup_minhash",
    "eps_edges",
    "dbscan_labels",
    "representatives",
    "cluster_keywords",
    "single_doc_words",
    "merged_windows",
    "category_payloads",
    "action_required",
    "suggestions",
    "explorer_categories",
    "json_in_text",
    "envelope_unwrap",
    "coverage_audit",
    "array_log",
    "intent_job",
    "fp_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logveil-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    start = time.perf_counter()
    landed_log(spark, folder)
    times["landed_log"] = round(time.perf_counter() - start, 3)
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
