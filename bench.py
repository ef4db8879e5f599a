"""Headline queries on one machine; prints one JSON line.

Every query runs once as a warm-up that does not count, then ``BENCH_RUNS`` times (3); its
figure is the median. Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores),
BENCH_QUERIES (comma-separated names, default: the headline list), BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "aggregate_windows", "window_totals", "window_documents", "majority_ip", "reaggregate", "scan_window_docs",
    "source_trigger_query", "pivot_rules", "common_rules", "translate_ids", "vectorize_family_first", "window_vectors",
    "expand_families", "finalize_rules", "job_windows", "alert_context", "upsert_events", "upsert_windows",
    "retention_dry_run", "table_summary", "evaluate", "gains_lift", "pr_curve", "stratified_split", "distance_outliers",
    "cluster_quality", "fit_dbscan", "stream_trigger_windows", "incremental_detect", "train_and_evaluate",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    from trigwatch.plans import load_all
    from trigwatch.session import local_session

    registered, _ = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "trigwatch-bench")
    seconds: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # every row is produced and dropped, so nothing is collected or pruned away
            registered[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(f"{name} {seconds[name]} (first {took[0]:.3f})", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total wall time of the headline queries, median of warm runs", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
