"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected to the driver). Before timing, every headline query runs
once on the smallest fixture ($BENCH_WARMUP_DIR, default sf0.001) so JVM
start-up, class loading and code generation are not counted: the timings
are steady-state per-query latencies. Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from transitlake.plans import catalog  # noqa: E402
from transitlake.session import get_spark  # noqa: E402

HEADLINE = [
    # the 14 reports in both profiles (+ the exact-integer variant of i)
    *[f"R_{c}_rel" for c in "abcdefghijklmn"], "R_i_rel_trunc",
    *[f"R_{c}_doc" for c in "abcdefghijklmn"],
    # dashboard tables and jobs
    "D04_stop_board", "D05_co2_trend", "D07_heat_points", "D08_stop_details", "D09_co2_by_quartier",
    "D10_quartier_features", "D15_co2_histogram",
    "M2_nest_arrets", "M4_nest_trafic", "Q1_parity", "Q3_integrity", "W1_corr_positional",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark("transitlake-bench", master=f"local[{cpus}]", shuffle_partitions=2 * cpus,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    queries = catalog.build()
    only = [a for a in sys.argv[1:] if a in queries]
    names = only or HEADLINE

    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    for name in names:  # warm-up on the small fixture (excluded from timings)
        queries[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir) \
            .write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
