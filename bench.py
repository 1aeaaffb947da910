"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""
import json
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "region_whole_shapes", "merged_area_by_layer", "intersection_area", "boundary_edges",
    "capacity_preflight", "halo_memberships", "segment_owners", "prepared_problem",
    "coverage_raster", "tile_rasters", "edge_probe_totals", "rectangle_shots",
    "signed_distances", "reconstructed_contours", "merged_contours",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES
    # A real query first, so that no headline pays for the start of the session.
    QUERIES["shape_kind_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf.group(1)) if sf else None}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
