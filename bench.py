"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder) and BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from cohortlens.plans.catalogue import QUERIES

HEADLINE = [
    "lexicon_scores",
    "note_sections",
    "training_corpus",
    "drug_band_join",
    "admission_extract",
    "characteristics_table",
    "structured_features",
    "logistic_c_sweep",
    "tfidf_terms",
    "attribution_by_term",
    "rank_metrics",
    "equal_frequency_bins",
    "decision_curves",
    "model_pair_tests",
    "top_quintile_overlap",
    "rank_ensembles",
    "fairness_table",
    "fairness_with_intervals",
    "bootstrap_intervals",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortlens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
