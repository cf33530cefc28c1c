"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (full execution, no
driver collect), once to warm up and then ``BENCH_REPEAT`` times; the best
time counts.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "job_flat_chunks",      # C10: pages -> clean -> sentences -> pack -> rows
    "job_section_chunks",   # D12: spans -> tree -> runs -> pack -> rows
    "clean_text",           # T15
    "chunk_pack",           # C06
    "job_ingest",           # M11: two batches, bucketed dynamic overwrite
    "job_embed",            # E07: encode (Arrow) + upsert
    "knn_batch",            # V02
    "retrieve_context",     # V07
    "parse_decision",       # A01
    "audit_runs",           # A06
    "sql_agg_basic",        # B10
    "sql_join_asof",        # B07
    "sql_win_rank",         # B16
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]

    from textmill.plans.registry import queries
    from textmill.session import get_session

    spark = get_session(f"local[{cpus}]", max(cpus, 8))
    spark.sparkContext.setLogLevel("ERROR")
    qs = queries()
    times = {}
    for n in names:
        best = None
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_best_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
