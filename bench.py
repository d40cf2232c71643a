"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is planned and executed in full into a no-op sink. A fresh JVM spends its first
queries on class loading and compilation, so a few run on the small tables before the clock starts.
"""
from __future__ import annotations

import json
import os
import time

from tapeloom.plans import QUERIES, base
from tapeloom.session import local_session

HEADLINE = [
    "sector_tilt_asof", "sector_tilt", "live_reference_day", "positioning_day", "delivery_state", "sector_breadth", "regime_history",
    "live_reference", "delivery_trend_week", "delivery_trend_day", "delivery_momentum", "positioning_asof",
    "eod_features", "screen_all_sessions", "evaluate_gated", "evaluate_top2", "decision_board", "carry_board",
    "carry_market", "ledger_reconcile", "multi_frame_bars", "structure_by_bar", "sr_levels", "first_trigger",
    "universe_scan", "big_wall", "footprint_board", "short_horizon_board", "tilt_welch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "").split()
    spark = local_session(cpus, "bench")
    for name in ("sector_tilt", "screen_all_sessions", "universe_scan"):
        small = "/root/testdata/sf0.001"
        if os.path.isdir(small):
            QUERIES[name].run(spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    if not only:
        t = time.perf_counter()
        base.store(spark, sf_dir)       # all prints folded once; the queries below read what they need of it
        times["session_store"] = round(time.perf_counter() - t, 3)
    for name in only or HEADLINE:
        t = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall clock", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
