"""Times the headline queries on local cores and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tempograin import queries as core

#: What the published figures of the field time: downsampling, reductions, gap fill, interpolation, reads, ingest, and the analytics stages.
HEADLINE = [
    "downsample_hours", "downsample_width_range", "downsample_percentiles", "downsample_time_weighted", "downsample_sketches", "rollup_substituted", "fill_linear", "fill_prev", "interpolate_linear", "interpolate_cubic",
    "read_time_range", "read_points", "read_value_band", "parquet_round_trip", "line_protocol", "store_read", "detect_all_peaks", "detect_drawdown", "signals_found", "asof_join", "sketch_lowest_collapsed", "downsample_orders_weekly",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        run(name)  # the published figures are warm as well
        best = float("inf")
        for _ in range(2):
            t = time.perf_counter()
            run(name)
            best = min(best, time.perf_counter() - t)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
