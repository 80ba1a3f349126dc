"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["dist_join_points", "dist_join_boxes", "dist_self_join", "intersects_points_boxes", "knn_k1", "knn_k5", "knn_k15", "knn_boxes", "stknn_instants", "stknn_intervals", "stknn_sparse", "interval_join"]


def main() -> None:
    from pyspark.sql import SparkSession

    from nighspark.queries import queries

    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run, found = queries(), {}
    run["knn_k1"](spark, sf).count()  # starts executors and compiles what all share
    for name in HEADLINE:
        began = time.time()
        run[name](spark, sf).write.format("noop").mode("overwrite").save()
        found[name] = round(time.time() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf}))


if __name__ == "__main__":
    main()
