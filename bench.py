"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion through the no-op sink (full execution, nothing collected).
The JVM is warmed once on the smallest scale factor first (not timed), so the numbers
measure the plans rather than class loading and JIT.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    ("training_dataset", "build marts: fact + rolling features"),
    ("entity_dim", "build marts: dimension"),
    ("dq_suite", "49 tests of three suites"),
    ("dq_warehouse", "55 tests over the warehouse tables"),
    ("detection_matrix", "anomaly comparator: 3 batches x 3 suites"),
    ("recon_summary", "reconcile 3 tables"),
    ("dq_suggest_rules", "rule generation"),
    ("rules_audit_summary", "rule audit"),
    ("stage_latest", "run-log analytics"),
    ("nested_explode", "nested JSON documents"),
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from matchlake.plans.registry import QUERIES
    from matchlake.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    warm = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(warm) and warm != sf_dir:
        for name, _ in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name, _ in HEADLINE:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
