"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is built (statistics jobs included) and then fully executed with
the no-op sink, so nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spruce.plans import registry  # noqa: E402
from spruce.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_clean_events", "col_profile", "num_describe", "cat_describe", "overview", "dataset_context",
    "fill_median", "fill_mode", "ffill", "ffill_by_user", "dups_find", "dedup_first", "dedup_documents",
    "iqr_stats", "cap_iqr", "bin_quantile", "one_hot", "group_rare", "case_title", "to_datetime_mixed",
    "rule_set", "hist", "hist_grouped", "box_stats", "bar_median", "bar_grouped_wide", "corr_matrix",
    "recipe_replay", "audit_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="spruce-bench")
    names = sys.argv[1:] or HEADLINE
    # warm-up on the smallest tables (JIT, codegen caches); not timed
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("flagship_clean_events", "col_profile", "dedup_first", "ffill"):
            registry.Q[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.Q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
