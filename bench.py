"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores). Every query runs
whole, once untimed to start code paths and once timed; results go to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "unique_url_features", "url_features", "canonicalize_url", "dedupe_keep_first", "page_tags",
    "classify_refs", "dom_features", "all_page_features", "canonical_records", "reason_counts",
    "hashed_buckets", "vectorize", "linear_score_join", "score_linear", "normalize_text",
    "sliding_windows", "window_count_stats", "max_pool", "score_prefix_sums", "average_precision",
    "metrics_report", "select_threshold", "tpr_at_fpr", "temporal_cutoff", "latency_summary",
    "percentile_interval", "grouped_split", "split_summary", "sample_manifest_hash",
    "base_rate_report", "paired_bootstrap", "align_by_id", "connected_groups", "archive_audit",
    "stream_counts", "score_stream", "latest_state_per_key",
]


def main() -> None:
    from sitesift.plans.catalog import QUERIES
    from sitesift.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
