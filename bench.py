"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from colonnade.plans import catalog

NAMES = ["gt_f64", "bet_f64", "add_i64_vec", "div_f64_vec", "sqrt_f64", "cast_f64_to_i64", "clip_f64_f64bounds", "bit_wise_and_popcount", "sum_f64_valid", "min_max_f64_valid", "extract_month", "truncate_month", "stat_stddev_f64", "stat_uniq_i64", "selective_sum", "grouped"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    entries, took = catalog.entries(), {}
    for name in NAMES:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            entries[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    print(json.dumps({"metric": "median seconds of a warm run, summed over queries", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": folder.rsplit("/sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
