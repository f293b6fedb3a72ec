"""Wall times of the headline queries at $BENCH_SF_DIR, as one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from touchline.registry import QUERIES

HEADLINE = ("ball_states", "possession_spans", "bridge_passes", "match_events", "player_kinematics", "team_stats", "heatmap", "presence_runs", "pass_network", "player_stats", "tackles")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
    spark = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["track_summary"](spark, sf_dir).count()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "match_queries_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
