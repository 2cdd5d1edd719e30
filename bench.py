"""Benchmark: headline stitching queries on the driver's tables.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) and prints
one JSON line ``{"metric", "value", "unit", "queries", "sf"}``; ``value`` is the total.
Each query is fully executed (``noop`` sink) in a fresh state (no memoised results).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sheetseam import catalog
    from sheetseam.session import get_spark

    spark = get_spark(f"local[{cpus}]", int(cpus), driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")

    headline = {
        # full layer stitches: both passes, merge, final ids, logs
        "stitch_polygons": catalog.q_finalise_layer,
        "stitch_lines": catalog.q_stitch_layer,
        # single operators on the whole tables
        "identify_pass": catalog.q_identify_pass,
        "region_join": catalog.q_region_join,
        "boundary_filter": catalog.q_boundary_filter,
        "detect_key": catalog.q_detect_key,
        "array_union_agg": catalog.q_array_union_agg,
        "wkt_ingest": catalog.q_wkt_ingest,
    }
    # warm the JVM once (class loading, codegen caches) so the first query is not penalised
    catalog.q_select_except(spark, sf_dir).write.mode("overwrite").format("noop").save()

    times = {}
    for name, fn in headline.items():
        catalog._CACHE.clear()  # every query does its full work
        t0 = time.time()
        fn(spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
