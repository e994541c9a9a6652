"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from scatterlake.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "bin_means", "bin_means_20", "bin_means_dedup", "rot_bins", "dpi_bins", "plot_dpi", "adjust_one_control", "adjust_two_controls",
    "adjust_categorical_3level", "adjust_fe_100_levels", "adjust_two_way_fe", "ci_pointwise", "ci_pointwise_control", "ci_rbc", "ci_rbc_two_way_fe",
    "poly_line_3", "fe_cells", "fe_bin_crosstab",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bin_counts"](spark, sf_dir).collect()  # warm-up: compile and read footers
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # no query is served by another one's frame
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).collect()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
