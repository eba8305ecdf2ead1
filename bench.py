"""Time the headline queries and print one JSON line.

Each query runs once to warm up and then three times; the median counts.  The
whole result is produced (no-op sink), nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

HEADLINE = [
    # relational core and telemetry
    "c3_snowflake_join", "d3_basic_measures", "d15_exact_order_statistic", "e3_top_k_per_group", "a12_upsert",
    "p5_telemetry_daily", "p10_baseline_anomalies", "p4_request_metrics", "i5_rate_limit",
    # semantic layer
    "o2_revenue_by_region", "o9_slice_equals_query",
    # documents
    "k1_parse_pages", "k4_unique_lines", "k5_drop_boilerplate", "k6_copy_labels", "k8_recursive_chunks",
    "k14_semantic_chunks", "n2_redact",
    # retrieval
    "c6_lookup_join", "l5_exact_top_k", "l9_keyword_search", "l10_hybrid_search", "l11_rerank",
    "l13_retrieval_metrics",
    # enrichment and evaluation
    "m1_classify", "m10_enrich_one_pass", "q7_rouge_n", "q9_perplexity", "m5_summarize", "q8_bleu", "q17_bootstrap_interval",
    # streams and stored cells
    "i8_metrics_upsert", "l6_all_cells",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE

    from larkspur.queries import QUERIES
    from larkspur.session import build_session, clear_work

    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
        extra={
            "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="larkspur-bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in chosen:
        times = []
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 4)
    line = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }
    clear_work(spark)
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
