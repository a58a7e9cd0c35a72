"""Time the headline queries; prints one JSON line.

Queries run in order in one session. The registry, diff and geometry results are built by the first query that
needs them (``stop_assignments``, ``diff_summary``, ``geom_diff``) and reused after, as in real use.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from checks.workspace import forget

HEADLINE = [
    "typed_stops", "stop_modes", "shape_modes", "lines_for_stop", "route_weekly_trips", "stop_departures",
    "route_directions", "shape_tangents", "stop_assignments", "diff_summary", "gtfs_diff_export", "freq_diff",
    "timeline_summary", "diff_lines_for_stop", "stop_categories", "grade_grid", "pop_delta", "geom_diff",
    "geom_lengths",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    forget()
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
