"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom.plans.queries import QUERIES

NAMES = ["degrees", "two_hop_neighbors", "jaccard", "all_pairs_jaccard", "triangle_count", "pagerank", "katz_centrality", "weakly_connected_components", "bfs", "core_number", "neighbor_sample", "uniform_random_walks", "hypergraph", "rmat"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    QUERIES["degrees"](spark, d).count()  # warms the session up
    for name in NAMES:
        t = time.time()
        QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline graph queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": d.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
