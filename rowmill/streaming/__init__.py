"""Operators on streaming tables.

Row-wise operators are ordinary projections and filters, so they work on a
streaming DataFrame as they are. The others need the whole table (row order,
ranks, medians, totals) and are refused before the stream is started.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROW_WISE = frozenset({
    "select_columns", "reorder_columns", "drop_columns", "normalize_column_names", "convert_column_type",
    "remove_empty_rows", "drop_rows_missing_keys", "fill_missing_values", "select_visible_rows",
    "normalize_text", "replace_values", "replace_text", "extract_text", "split_column", "combine_columns",
    "clean_numeric_values", "round_numbers", "calculate_column", "compare_columns",
    "add_date_parts", "calculate_date_difference",
    "filter_rows", "filter_by_conditions", "filter_relative_dates", "filter_calendar_period",
    "add_conditional_column", "mark_missing_required", "mark_error_values",
    "highlight_rows", "highlight_missing", "format_numbers",
})


def require_row_wise(df: DataFrame, operator: str) -> None:
    """Raise where a streaming table meets an operator that needs all rows."""
    if df.isStreaming and operator not in ROW_WISE:
        raise ValueError(f"{operator} needs the whole table and cannot run on a stream")
