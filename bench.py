"""Headline queries, warm, median of three: prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillspark.plans.registry import QUERIES

HEADLINE = ["diff_status_counts", "diff_field_deltas", "diff_detail_page", "apply_result_table", "grid_overlay", "page_wrapper", "row_window_trim", "export_csv_lines", "value_profile", "pattern_frequency", "dedupe_keep_last", "group_having", "window_frames", "asof_join", "grouping_sets", "jaccard_sets", "schema_diff_columns", "create_table_ddl"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
