"""Times the headline queries and prints one JSON line.

Each query is built anew for every run, as finished shuffles of an old DataFrame
would be reused. One warm-up run, then the median of BENCH_RUNS.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import tractwise
from verification import views
from verification.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

HEADLINE = [
    "patron_stats",
    "patron_stats_direct",
    "patron_stats_all_libraries",
    "patron_rollup",
    "map_layer",
    "dual_layer",
    "metric_long",
    "geojson_features",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tractwise-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def library_loop(spark: SparkSession, sf_dir: str) -> None:
    """One job per library, to compare with the job for all of them."""
    tables = views.tables(spark, sf_dir)
    for row in views.catalogue(spark, sf_dir).select("tracts").collect():
        run(tractwise.patron_stats(tables, row.tracts, views.AS_OF))


def seconds(action) -> float:
    times = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    spark = session()
    timings = {
        name: seconds(lambda query=QUERIES[name]: run(query(spark, SF_DIR))) for name in HEADLINE
    }
    timings["patron_stats_library_loop"] = seconds(lambda: library_loop(spark, SF_DIR))
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
