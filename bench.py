"""Time the headline queries: python bench.py prints one JSON line.

One query warms the session up; each headline query is then measured on its first run.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from siftmill.plans.registry import load_all  # noqa: E402
from siftmill.session import build_session  # noqa: E402

HEADLINE = [
    "scan_summary", "rule_table_scan_138", "rule_table_scan", "prose_violations", "code_violations", "context_guard", "absence_per_file", "cross_check_scope", "undefined_references",
    "incremental_scan", "grouped_report", "server_detectors", "client_detectors", "code_inventory", "file_coverage", "taint_flows", "calls_in_loops",
    "naming_violations", "repeated_blocks", "dependency_edges", "page_components", "class_conflicts", "violation_trend", "regression_check",
    "project_summary", "rule_confidence", "tuning_decisions", "correlated_rules", "related_duplicates", "edit_conflicts", "severity_chain",
    "ab_test_winners", "best_threshold", "generation_quality", "savings_daily", "savings_by_operation", "output_quality", "common_files",
    "running_trust", "style_facts", "dismiss_phrases", "anomalies", "text_clusters", "duplicate_clusters", "vector_clusters", "fix_candidates",
    "rule_quality_model", "session_stream", "daily_counts_stream",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    catalog["severity_counts"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
