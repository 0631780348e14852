"""Seconds of the headline queries: one warm-up, then the median of three runs; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = [
    "sc6_parquet_scan", "j8_range_join", "j9_tiered_lookup", "j11_jaccard_join", "j12_feature_join", "a13_entropy", "a14_stereotypy", "a23_cooccurrence", "a28_calibration",
    "w2_average_rank", "g6_two_paths", "g8_k_hop", "g10_components", "g17_propagation", "k1_entity_walk", "k4_attention", "k10_hierarchical", "k20_held_out",
    "v1_kaplan_meier", "v2_log_rank", "v4_v5_cox_atlas", "v7_c_index", "e3_column_correlation", "e2_cosine", "d2_d4_chunks", "d12_tfidf", "st1_tumbling",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from ostrakon.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "sum of medians of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
