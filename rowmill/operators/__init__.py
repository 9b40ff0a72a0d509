"""The table operators by name, as step lists and users call them."""

from rowmill.operators.cleaning import (
    drop_rows_missing_keys, fill_missing_values, remove_duplicates, remove_empty_rows, select_visible_rows,
)
from rowmill.operators.dates import (
    add_date_parts, calculate_date_difference, filter_calendar_period, filter_relative_dates,
)
from rowmill.operators.filters import add_conditional_column, filter_by_conditions, filter_rows
from rowmill.operators.groups import group_aggregate, group_average, group_count, group_sum, pivot_table
from rowmill.operators.numeric import calculate_column, clean_numeric_values, compare_columns, round_numbers
from rowmill.operators.present import (
    color_scale, format_numbers, highlight_extremes, highlight_missing, highlight_rows,
)
from rowmill.operators.quality import mark_error_values, mark_missing_required
from rowmill.operators.shape import (
    convert_column_type, drop_columns, normalize_column_names, reorder_columns, select_columns,
)
from rowmill.operators.sorting import keep_latest_per_group, select_top_n, sort_rows
from rowmill.operators.text import (
    combine_columns, extract_text, normalize_text, replace_text, replace_values, split_column,
)
from rowmill.operators.totals import add_conditional_summary_row, add_subtotals, add_total_row
from rowmill.operators.windows import cumulative_sum, mark_duplicates, percent_change, rank_rows

DATA_OPERATORS = {
    f.__name__: f
    for f in (
        select_columns, reorder_columns, drop_columns, normalize_column_names, convert_column_type,
        remove_empty_rows, remove_duplicates, drop_rows_missing_keys, fill_missing_values, select_visible_rows,
        normalize_text, replace_values, replace_text, extract_text, split_column, combine_columns,
        clean_numeric_values, round_numbers, calculate_column, compare_columns,
        add_date_parts, calculate_date_difference,
        filter_rows, filter_by_conditions, filter_relative_dates, filter_calendar_period, add_conditional_column,
        sort_rows, select_top_n, keep_latest_per_group,
        group_sum, group_average, group_count, group_aggregate, pivot_table,
        rank_rows, cumulative_sum, percent_change, mark_duplicates,
        add_subtotals, mark_missing_required, mark_error_values,
    )
}
HIGHLIGHT_OPERATORS = {f.__name__: f for f in (highlight_rows, highlight_extremes, highlight_missing, color_scale)}
SUMMARY_OPERATORS = {f.__name__: f for f in (add_total_row, add_conditional_summary_row)}
FORMAT_OPERATORS = {f.__name__: f for f in (format_numbers,)}
OUTPUT_OPERATORS = HIGHLIGHT_OPERATORS | SUMMARY_OPERATORS | FORMAT_OPERATORS
OPERATORS = DATA_OPERATORS | OUTPUT_OPERATORS

__all__ = ["DATA_OPERATORS", "OPERATORS", "OUTPUT_OPERATORS", *OPERATORS]
