"""Ranks, running totals, percentage change and duplicate marks.

Row order is always explicit. Groups too large for one task, and order values that
too many rows share, are cut into ranges (see `rowmill.plans.hot_ranges`);
`rows_per_task` sets that size. Rows that tie on all order columns come in no
particular order, but each sees the others in the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    col, columns_of, is_missing, kind, or_null, require_columns, to_double, to_number, type_of,
)
from rowmill.plans.hot_ranges import ROWS_PER_TASK, SOURCE_ROW, Order, Split, order_of, split
from rowmill.plans.lineage import materialize

RANK_METHODS = ("average", "min", "max", "first", "dense")


def _rank_expression(method: str, at_least: Column, ties: Column, distinct: Column) -> Column:
    """Rank from the smallest position, the number of ties and the distinct position."""
    return {
        "min": at_least,
        "max": at_least + ties - 1,
        "average": (at_least * 2 + ties - 1) / 2,
        "dense": distinct,
    }[method].cast("double")


def _rank_by_value(df: DataFrame, keys: list[str], order: Order, method: str, result_column: str, rows_per_task: int) -> DataFrame:
    """Ranks of distinct values, joined back to the rows.

    A value that fills much of the table is one row here, and the join back is
    an ordinary equi-join that adaptive execution splits where it is skewed.
    """
    name, count = "_value", "_count"
    value = or_null(df, order.column)
    counted = (
        df.filter(~is_missing(df, order.column))
        .groupBy(*[col(k) for k in keys], value.alias(name))
        .agg(F.count(F.lit(1)).alias(count))
    )
    parts = split(materialize(counted), keys, [Order(name, order.ascending)], rows_per_task)
    rows, upto, distinct = parts.rows, F.sum(count).over(parts.running), F.row_number().over(parts.window)
    if parts.hot:
        rows = parts.carry(rows, {"_upto": F.sum(count), "_distinct": F.count(F.lit(1))})
        upto = upto + F.coalesce(F.col("_upto"), F.lit(0))
        distinct = distinct + F.coalesce(F.col("_distinct"), F.lit(0))
    rank = _rank_expression(method, upto - F.col(count) + 1, F.col(count), distinct)
    renamed = {k: f"_rank_key{i}" for i, k in enumerate(keys)}
    ranks = rows.select(
        *[col(k).alias(r) for k, r in renamed.items()], F.col(name), rank.alias("_rank")
    )
    match = [col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
    joined = df.join(ranks, [*match, value == F.col(name)], "left")
    return joined.withColumn(result_column, F.col("_rank")).drop(*renamed.values(), name, "_rank")


def number_rows(df: DataFrame, keys: list[str], order: list[Order], present: Column, result_column: str, rows_per_task: int) -> DataFrame:
    """Numbers from 1 in the given order for rows that take part, null for others; ties in any order."""
    parts = split(df, keys, order, rows_per_task, only=present, cut_ties=True)
    rows, window = _apart(parts, present)
    number = F.row_number().over(window)
    if parts.hot:
        rows = parts.carry(rows, {"_carried": F.count(F.when(present, F.lit(1)))})
        number = number + F.coalesce(F.col("_carried"), F.lit(0))
    return parts.finish(rows.withColumn(result_column, F.when(present, number)), ["_aside", "_carried"])


def _apart(parts: Split, present: Column) -> tuple[DataFrame, WindowSpec]:
    """The rows and their window; rows that take no part are spread over tasks by their input partition."""
    rows = parts.rows.withColumn("_aside", F.when(present, F.lit(-1)).otherwise(F.spark_partition_id()))
    slots = [*[col(k) for k in parts.keys], F.col("_aside"), *([F.col("_range")] if parts.hot else [])]
    return rows, Window.partitionBy(*slots).orderBy(*parts.sort)


def rank_rows(
    df: DataFrame, column: str, result_column: str = "rank", ascending: bool = False, method: str = "dense",
    group_columns: list[str] | str | None = None, order_columns: list[str] | str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rank of a value in its group or in the table, as a double; null has no rank.

    `order_columns` break ties for method="first".
    """
    if method not in RANK_METHODS:
        raise ValueError(f"unknown rank method: {method!r}")
    require_columns(df, [column])
    keys = columns_of(group_columns)
    ties = order_of(df, order_columns, "rank method 'first'") if method == "first" else []
    order = [Order(column, ascending), *ties]
    present = ~is_missing(df, column)
    if method == "first":
        ranked = number_rows(df, keys, order, present, result_column, rows_per_task)
        return ranked.withColumn(result_column, col(result_column).cast("double"))
    parts = split(df, keys, order, rows_per_task, only=present)
    if parts.hot:
        return _rank_by_value(df, keys, order[0], method, result_column, rows_per_task)
    rows, window = _apart(parts, present)
    # Peers of the row, counted in the same sort as the rank.
    peers = window.rangeBetween(Window.currentRow, Window.currentRow)
    tied = F.count(F.lit(1)).over(peers) if method in ("max", "average") else F.lit(1)
    rank = _rank_expression(method, F.rank().over(window), tied, F.dense_rank().over(window))
    return parts.finish(rows.withColumn(result_column, F.when(present, rank)), ["_aside"])


def cumulative_sum(
    df: DataFrame, value_column: str, result_column: str = "running_total",
    group_columns: list[str] | str | None = None, order_columns: list[str] | str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Running sum in row order, per group or over the table; null counts as 0."""
    order = order_of(df, order_columns, "cumulative_sum")
    parts = split(df, group_columns, order, rows_per_task, cut_ties=True)
    number = to_number(df, value_column)
    value = F.coalesce(number, F.lit(0)) if kind(type_of(df, value_column)) == "number" else F.coalesce(number, F.lit(0.0))
    rows, total = parts.rows, F.sum(value).over(parts.running)
    if parts.hot:
        rows = parts.carry(rows, {"_carried": F.sum(value)})
        total = total + F.coalesce(F.col("_carried"), F.lit(0))
    return parts.finish(rows.withColumn(result_column, total), ["_carried"])


def _change(current: Column, previous: Column) -> Column:
    infinite = F.when(current > 0, F.lit(float("inf"))).when(current < 0, F.lit(float("-inf")))
    return F.when(previous == 0, infinite).otherwise((F.try_divide(current, previous) - 1) * 100)


def percent_change(
    df: DataFrame, value_column: str, result_column: str = "pct_change",
    group_columns: list[str] | str | None = None, order_columns: list[str] | str | None = None,
    periods: int = 1, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Change against `periods` rows before, in percent; nulls repeat the last value."""
    if isinstance(periods, bool) or not isinstance(periods, int) or periods == 0:
        raise ValueError("periods must be a whole number other than 0")
    order = order_of(df, order_columns, "percent_change")
    parts = split(df, group_columns, order, rows_per_task, cut_ties=True)
    value = to_double(df, value_column)
    filled = F.last(value, ignorenulls=True).over(parts.running)
    if not parts.hot:
        rows = parts.rows.withColumn("_filled", filled)
        before = F.lag("_filled", periods).over(parts.window)
        return rows.withColumn(result_column, _change(F.col("_filled"), before)).drop("_filled")
    # The last value of each range: by row order, ascending in every column.
    place = F.struct(*[c for o in parts.order for c in (is_missing(parts.rows, o.column), col(o.column))])
    rows = parts.carry(parts.rows, {"_seen": F.max_by(value, F.when(value.isNotNull(), place))}, last=True)
    rows = rows.withColumn("_filled", F.coalesce(filled, F.col("_seen")))
    if periods == 1:
        # Before a range's first row comes the last filled value of the earlier ranges.
        before = F.when(F.row_number().over(parts.window) == 1, F.col("_seen")).otherwise(
            F.lag("_filled", 1).over(parts.window)
        )
        changed = rows.withColumn(result_column, _change(F.col("_filled"), before))
        return parts.finish(changed, ["_seen", "_filled"])
    # Farther back: number the rows of each group and join row n with row n - periods.
    rows = parts.carry(rows, {"_carried": F.count(F.lit(1))})
    number = F.row_number().over(parts.window) + F.coalesce(F.col("_carried"), F.lit(0))
    rows = rows.withColumn("_number", number)
    renamed = {k: f"_before_key{i}" for i, k in enumerate(parts.keys)}
    earlier = rows.select(
        *[col(k).alias(r) for k, r in renamed.items()], (F.col("_number") + periods).alias("_at"),
        F.col("_filled").alias("_before"),
    )
    match = [col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()] + [F.col("_number") == F.col("_at")]
    joined = rows.join(earlier, match, "left")
    changed = joined.withColumn(result_column, _change(F.col("_filled"), F.col("_before")))
    return parts.finish(changed, ["_seen", "_filled", "_carried", "_number", "_at", "_before", *renamed.values()])


def visible(df: DataFrame) -> list[str]:
    """Columns that hold data: names with a leading _ say where a row comes from."""
    return [n for n in df.columns if not n.startswith("_")] or df.columns


def _all_keys(df: DataFrame, subset: list[str] | str | None) -> list[str]:
    names = columns_of(subset) or visible(df)
    require_columns(df, names)
    return names


def mark_duplicates(
    df: DataFrame, subset: list[str] | str | None = None, result_column: str = "is_duplicate",
    keep: str | bool = False, order_columns: list[str] | str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Flag repeated keys: every copy (keep=False), or all but the first or last."""
    if keep not in (False, "first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = _all_keys(df, subset)
    if keep is False:
        # Any order will do; the key columns themselves cannot cut a hot key, so rows are spread by position.
        place = df.withColumn("_place", F.monotonically_increasing_id())
        return _mark_every_copy(place, keys, result_column, rows_per_task)
    if columns_of(subset) or order_columns or SOURCE_ROW in df.columns:
        order = order_of(df, order_columns, "mark_duplicates")
    else:  # equal rows are interchangeable; their position cuts a row with very many copies
        df, order = df.withColumn("_place", F.monotonically_increasing_id()), [Order("_place")]
    if keep == "last":
        order = [Order(o.column, not o.ascending) for o in order]
    parts = split(df, keys, order, rows_per_task, cut_ties=True)
    rows, number = parts.rows, F.row_number().over(parts.window)
    if parts.hot:
        rows = parts.carry(rows, {"_carried": F.count(F.lit(1))})
        number = number + F.coalesce(F.col("_carried"), F.lit(0))
    return parts.finish(rows.withColumn(result_column, number > 1), ["_carried", "_place"])


def _mark_every_copy(df: DataFrame, keys: list[str], result_column: str, rows_per_task: int) -> DataFrame:
    parts = split(df, keys, [Order("_place")], rows_per_task)
    rows = parts.totals(parts.rows, {"_copies": F.count(F.lit(1))})
    return parts.finish(rows.withColumn(result_column, F.col("_copies") > 1), ["_copies", "_place"])
