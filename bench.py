"""Times the headline queries on the given tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "v05_filtered_search",
    "v08_batch_search",
    "v09_whole_frame_baseline",
    "a11_retrieval_metrics",
    "j02_cross_camera_associations",
    "j03_standing_rules",
    "d01_temporal_dedup",
    "d02_class_group_nms",
    "j06_secondary_suppression",
    "a01_track_summary",
    "f07_track_quality_filter",
    "d05_chain_merge",
    "s02_video_upsert",
    "u01_time_window",
    "a18_named_colour_histogram",
    "t02_effective_fps",
]


def main() -> None:
    from camtrail.scale import session
    from checks.all_queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = session("bench", cores, shuffle=int(cores))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in wanted:
        run(name)  # warm-up: code generation and Python workers
        seconds[name] = round(min(run(name) for _ in range(2)), 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
