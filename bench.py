"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES  # noqa: E402

HEADLINE = [
    "analyze_orders", "auto_compare", "auto_compare_by_segment", "clean_orders", "iqr_filter_sequential",
    "describe_lineitem", "describe_by_supplier", "normality_orders", "shapiro_by_customer", "kruskal_events",
    "kruskal_quantity", "mann_whitney", "wilcoxon", "paired_t", "welch_t", "anova_events", "pairwise_mann_whitney",
    "tukey_events", "ols_multi", "ols_fit_by_flag", "vif_eliminate", "pearson_table", "spearman_table",
    "mediation_full", "instrument_items", "corr_matrix", "box_stats", "adf_t", "kpss_eta", "forecast5", "var_fit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("autostat-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    # One pass over the smallest tables, so that JVM and Python start-up is not charged to the first query.
    small = "/root/testdata/sf0.001"
    for name in ("welch_t", "analyze_orders"):
        QUERIES[name](spark, small if os.path.isdir(small) else folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    out = {
        "metric": "total wall-clock of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
