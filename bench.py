"""Time the headline queries and print one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "shot_rule_eval", "coverage", "closest_approach", "plane_crossings", "geometry_block",
    "crossing_sizes", "gap_interpolate", "spike_reject", "event_clusters", "windows_hit",
    "nearest_within_tolerance", "density_cluster", "camera_offset", "parabola_lsq", "descent_stats",
    "verdict_parse", "ensemble_pair", "three_way_vote", "tally_by_class", "tiered_merge",
    "auc_by_group", "threshold_floor", "quantile_compare", "frame_energy", "triangulate",
    "fused_shot_features", "descent_verdict", "clean_track", "ransac_parabola", "spotter_stream",
)


def main() -> None:
    from pyspark.sql import SparkSession
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from orbweave.plans import catalog
    catalog.QUERIES["coverage"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
