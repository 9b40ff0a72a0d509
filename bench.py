"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs
per query (their median counts, after one warm-up run). Names given as
arguments replace the headline list; `all` runs every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "net_sales_by_return_flag", "filter_by_conditions", "filter_by_condition_groups", "filter_relative_dates_last_n_days",
    "add_conditional_column", "normalize_text", "replace_text", "extract_text_after_last", "split_column", "clean_numeric_values_coerced",
    "round_numbers", "calculate_column_divide", "compare_columns", "calculate_date_difference_in_months", "add_date_parts",
    "remove_duplicates_first", "remove_duplicates_keeping_none", "keep_latest_per_group", "keep_latest_per_group_with_ties", "sort_rows",
    "select_top_n", "group_sum", "group_aggregate", "group_aggregate_median_of_hot_groups", "pivot_table_sum", "rank_rows_dense_per_customer",
    "rank_rows_average_over_all", "rank_rows_dense_over_all_cut", "cumulative_sum_per_customer", "cumulative_sum_over_all_cut",
    "percent_change_per_customer_1", "percent_change_over_all_cut_1", "mark_duplicates_every_copy", "add_subtotals", "add_total_row_sum",
    "add_conditional_summary_row_sum_two", "highlight_extremes_top_n", "color_scale", "format_numbers_currency", "profile_table",
    "profile_table_of_many_rows", "color_scale_over_many_rows", "select_top_n_of_a_long_list", "find_values", "find_filter_candidates", "find_table_regions", "read_region", "combine_files", "preview_steps",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("rowmill-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from querybook import QUERIES

    names = sys.argv[1:] or HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "runs": runs,
    }))


if __name__ == "__main__":
    main()
