"""Sorting, top N, and the latest row of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.columns import checked_timestamp, col, columns_of, fail_if, require_columns, require_number
from rowmill.plans.hot_ranges import ROWS_PER_TASK, Order, order_of, row_hash, sort_columns, source_order
from rowmill.operators.windows import number_rows
from rowmill.plans.selection import TOTAL, VALUE, nth_value

# Spark's own top-n holds so many rows in one task at most; longer lists never meet in one.
SHORT_LIST = 1000


def sort_rows(df: DataFrame, columns: list[str] | str, ascending: list[bool] | bool = True) -> DataFrame:
    """Sort with nulls last in both directions; keep it as the last step before the sink.

    Ties are in no particular order. A hash of the row comes after the sort
    columns, so that a value many rows share is spread over tasks like any other.
    """
    names = columns_of(columns)
    require_columns(df, names)
    if not names:
        raise ValueError("name at least one sort column")
    directions = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if len(directions) != len(names):
        raise ValueError("one direction per sort column is needed")
    keys = sort_columns(df, [Order(n, a) for n, a in zip(names, directions)])
    spread = row_hash(df, names)
    return df.orderBy(*keys, *([spread] if spread is not None else []))


def top_order(df: DataFrame, column: str, largest: bool, order_columns: list[str] | str | None) -> list[Order]:
    """Value first, then row order for ties where one is known."""
    ties = columns_of(order_columns) or source_order(df)
    require_columns(df, ties)
    return [Order(column, not largest), *[Order(t) for t in ties]]


def select_top_n(
    df: DataFrame, column: str, n: int = 10, largest: bool = True, order_columns: list[str] | str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The n rows with the largest or smallest number; `order_columns` decide ties.

    The n-th value of a long list is found first; rows beyond it are left out, and the
    rest are numbered in ranges, so that no task receives the whole list.
    """
    require_number(df, [column])
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a whole number of at least 1")
    order = top_order(df, column, largest, order_columns)
    if n <= SHORT_LIST:
        return df.orderBy(*sort_columns(df, order)).limit(n)
    last = nth_value(df, column, n, largest).first()
    reached = last is not None and last[TOTAL] >= n
    limit = F.lit(last[VALUE]) if reached else None
    value = col(column).cast("double")
    # comparing as doubles keeps at least the rows that belong to the list
    rows = df.filter(value >= limit if largest else value <= limit) if reached else df
    numbered = number_rows(rows, [], order, F.lit(True), "_number", rows_per_task)
    kept = numbered.filter(F.col("_number") <= n).drop("_number")
    return kept.orderBy(*sort_columns(kept, order))


def keep_latest_per_group(
    df: DataFrame, group_columns: list[str] | str, date_column: str, keep_ties: bool = False,
    order_columns: list[str] | str | None = None,
) -> DataFrame:
    """Rows with the newest date of their group: all of them, or the last in row order.

    A group without any date fails the job. Without ties Spark keeps one row per
    group and task before the shuffle; with ties the newest date per group is
    aggregated and joined back, which adaptive execution splits where it is skewed.
    """
    keys = columns_of(group_columns)
    if not keys:
        raise ValueError("name at least one group column")
    require_columns(df, [*keys, date_column])
    message = "a group without a date has no latest row"
    dated = df.withColumn("_date", checked_timestamp(df, date_column, "latest row per group"))
    if not keep_ties:
        order = [Order("_date", False), *[Order(o.column, False) for o in order_of(df, order_columns, "keep_latest_per_group")]]
        window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(dated, order))
        latest = dated.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") == 1)
        known = fail_if(F.col("_date").isNull(), message, F.lit(True))
        return latest.filter(known).drop("_place", "_date")
    names = {k: f"_latest_key{i}" for i, k in enumerate(keys)}
    newest = dated.groupBy(*[col(k).alias(n) for k, n in names.items()]).agg(F.max("_date").alias("_newest"))
    match = [col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = dated.join(newest, match, "left")
    latest = joined.filter(fail_if(F.col("_newest").isNull(), message, F.col("_date") == F.col("_newest")))
    return latest.drop(*names.values(), "_newest", "_date")
