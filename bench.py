"""Time the headline queries: one JSON line on standard output.

Each query is fully computed into Spark's no-op sink, so that writing results to the driver is not part of the figure.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tickloom.catalog import QUERIES  # noqa: E402
from tickloom.session import build_session  # noqa: E402

HEADLINE = [
    "bars_30m",
    "sma_cross_fills",
    "asof_join",
    "asof_supplier_price",
    "next_bar",
    "interval_merge",
    "interval_gaps",
    "moving_averages",
    "macd_histogram",
    "rule_truth",
    "flow_decisions",
    "gate_spaced_bars",
    "limit_fills",
    "booked_fills",
    "fifo_slices",
    "equity_curve_cost",
    "equity_curve_mtm",
    "performance_metrics",
    "failure_histogram",
    "part_manifest",
    "run_digests",
    "run_assessment",
    "request_intake",
    "plan_lint",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "tickloom-bench")
    QUERIES["bars_30m"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in only or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
