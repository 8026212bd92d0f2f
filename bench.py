"""Headline queries over BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

One warm-up, then the median of five runs of each query on the fact that hold() keeps, as the engine serves requests.
"fact" is the time to build and hold it; "cold_country_profile" joins from the files.
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from rostra.plans.catalogue import QUERIES
from rostra.sources import testdata

HEADLINE = ["country_profile", "leader_profile_topn", "yearly_global", "yearly_country_all", "leader_trend", "dtype_counts", "global_stats", "distribution_country", "movers", "radar_long", "scatter_outliers", "doc_word_count", "doc_chunks"]


def timed(f) -> float:
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
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
    run = lambda name: QUERIES[name](spark, sf).collect()
    run("country_profile")
    out = {"cold_country_profile": statistics.median(timed(lambda: run("country_profile")) for _ in range(3))}
    out["fact"] = timed(lambda: testdata.hold(spark, sf))
    for name in HEADLINE:
        run(name)
        out[name] = statistics.median(timed(lambda n=name: run(n)) for _ in range(5))
    out = {k: round(v, 4) for k, v in out.items()}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(out[n] for n in HEADLINE), 4), "unit": "sec", "queries": out, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
