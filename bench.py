"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, the fastest counts (default 3)
"""

from __future__ import annotations

import json
import os
import sys
import time

from gridledger.plans.catalogue import all_queries
from gridledger.session import local_session

HEADLINE = [
    "q01_overview_kpi",               # unified view, whole scan
    "q02_state",                      # flagship: state x carrier
    "q24_cumulative_buildout",        # running totals
    "u01_units_all",                  # union of eight tables
    "l01_top_plz",                    # top-k over postcodes
    "q21_grid_points",                # grouping sets
    "q28_size_mix_mw",                # 17-column pivot
    "q29_bucket_matrix_gross",        # matrix with totals and shares
    "q32_solar_table_month",          # period deltas
    "q36_registration_delay",         # exact quantiles
    "q38_late_registration",          # year x year pivot
    "q39_monthly_segments",           # detail and grand totals
    "q43_district_assets",            # three tables to districts
    "q54_traffic_summary",            # access log, five summaries in one pass
    "q60_battery_kpi",                # schema-tolerant storage fleet
    "a24_day_quantiles",              # fact-to-fact join, exact quantiles
    "a25_median",                     # exact median of a continuous column
    "s01_s05_xml_to_typed",           # write and parse XML, type columns
    "s07_dedup",                      # last-updated row per id
    "s11_s28_written_aggregate",      # all seven aggregates written, one read
    "t03_counter_rate",               # counter rates with restarts
]


def timed(run, spark, sf_dir: str) -> float:
    started = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench", **{"spark.ui.showConsoleProgress": "false"})
    queries = all_queries()
    seconds = {}
    for name in HEADLINE:
        timed(queries[name], spark, sf_dir)  # warm: code generation, footers, page cache
        seconds[name] = round(min(timed(queries[name], spark, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    sys.stdout.write(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1],
    }) + "\n")


if __name__ == "__main__":
    main()
