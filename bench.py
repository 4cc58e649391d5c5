"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs twice from the files, the second run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HEADLINE = (
    "features_build", "features_from_pixels", "stats_seven_moments", "window_assign", "labels_to_long",
    "labels_first_severe", "split_random_orders", "scenes_valid_orbits", "obs_at_points", "obs_fill_mean",
    "predict_orbit_mean", "eval_metrics", "eval_sweep_fine", "geo_point_in_polygon", "geo_pixel_overlap",
    "geo_disk_overlap", "geo_within_distance", "building_scores", "building_attach_labels", "stats_by_admin",
    "pixel_focal_mean", "pixel_mosaic", "pixel_sample_window_max", "io_read_features", "stream_score",
    "model_random_forest", "run_metrics", "run_score_tiles",
)


def main() -> None:
    from changemap.plans import catalog
    from changemap.session import get_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="12g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        spark.catalog.clearCache()
        t = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    # one warm-up and one measured run each: a fresh JVM would mostly measure the
    # compilation of generated code
    times, cold = {}, {}
    for n in names:
        cold[n] = round(run(n), 3)
        times[n] = round(run(n), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
