"""Grouped aggregates and the pivot.

All of them combine on the map side before the shuffle, so a group that holds
much of the table costs one partial row per task. Group keys keep null. The
result has no order; chain `sort_rows` where one is wanted.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    col, columns_of, is_missing, or_null, require_columns, require_number, text_of, to_text, type_of,
    typed_literal,
)
from rowmill.plans.selection import medians

FUNCTIONS = ("sum", "mean", "count", "size", "nunique", "min", "max", "median")
NUMERIC_ONLY = ("sum", "mean", "median")
PIVOT_FUNCTIONS = ("sum", "mean", "count", "min", "max")
PIVOT_LIMIT = 10_000


def aggregate(df: DataFrame, column: str, function: str) -> Column:
    """One aggregate over the present values of a column."""
    if function == "size":
        return F.count(F.lit(1))
    if function in NUMERIC_ONLY:
        require_number(df, [column])
    value = or_null(df, column)
    if function == "sum":
        return F.coalesce(F.sum(value), F.lit(0).cast(type_of(df, column)))
    return {
        "mean": F.avg, "count": F.count, "nunique": F.count_distinct, "min": F.min, "max": F.max,
    }[function](value)


def _keys(df: DataFrame, group_columns: list[str] | str) -> list[str]:
    names = columns_of(group_columns)
    if not names:
        raise ValueError("name at least one group column")
    require_columns(df, names)
    return names


def _group(df: DataFrame, keys: list[str], **results: Column) -> DataFrame:
    return df.groupBy(*[col(k) for k in keys]).agg(*[value.alias(name) for name, value in results.items()])


def group_sum(
    df: DataFrame, group_columns: list[str] | str, value_column: str, result_column: str = "sum",
) -> DataFrame:
    """Sum per group; a group of nulls sums to 0."""
    return _group(df, _keys(df, group_columns), **{result_column: aggregate(df, value_column, "sum")})


def group_average(
    df: DataFrame, group_columns: list[str] | str, value_column: str, result_column: str = "average",
) -> DataFrame:
    """Mean of the present values per group."""
    return _group(df, _keys(df, group_columns), **{result_column: aggregate(df, value_column, "mean")})


def group_count(df: DataFrame, group_columns: list[str] | str, result_column: str = "count") -> DataFrame:
    """Rows per group."""
    return _group(df, _keys(df, group_columns), **{result_column: F.count(F.lit(1))})


def group_aggregate(
    df: DataFrame, group_columns: list[str] | str, aggregations: list[dict[str, str]],
    approximate: bool = False,
) -> DataFrame:
    """Several named aggregates per group in one pass.

    Medians are exact: they are found by counting in ranges (see
    `rowmill.plans.selection`), all of them in the same passes, and joined by key.
    `approximate=True` uses sketches for median and nunique.
    """
    keys = _keys(df, group_columns)
    if not aggregations:
        raise ValueError("name at least one aggregate")
    names = [item["result_column"] for item in aggregations]
    if len(set(names)) != len(names) or set(names) & set(keys):
        raise ValueError("result names must differ from each other and from the group columns")
    plain: dict[str, Column] = {}
    middles: dict[str, str] = {}
    for item in aggregations:
        column, function, name = item["column"], item["function"], item["result_column"]
        if function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate: {function!r}")
        require_columns(df, [column])
        if function == "median":
            require_number(df, [column])
        if approximate and function == "nunique":
            plain[name] = F.approx_count_distinct(or_null(df, column))
        elif approximate and function == "median":
            plain[name] = F.percentile_approx(or_null(df, column), 0.5).cast("double")
        elif function == "median":
            middles[name] = column
        else:
            plain[name] = aggregate(df, column, function)
    result = _group(df, keys, **(plain or {"_rows": F.count(F.lit(1))}))
    if middles:
        # one row per group on both sides
        slots = {f"_median{i}": c for i, c in enumerate(middles.values())}
        part = medians(df, keys, slots).withColumnsRenamed({k: f"_right_{i}" for i, k in enumerate(keys)})
        match = [col(k).eqNullSafe(F.col(f"_right_{i}")) for i, k in enumerate(keys)]
        result = result.join(part, match, "left").withColumnsRenamed(dict(zip(slots, middles)))
    return result.select(*[col(k) for k in keys], *[col(n) for n in names])


def pivot_table(
    df: DataFrame, index_columns: list[str] | str, pivot_column: str, value_column: list[str] | str,
    aggfunc: str = "sum", fill_value: Any = 0, pivot_values: list[str] | None = None, max_values: int = PIVOT_LIMIT,
) -> DataFrame:
    """Cross table: one row per index, one column per pivot value.

    Rows with a null index or pivot value are left out. One value column given
    as text names the columns by pivot value; a list names them
    `<value column> <pivot value>`. The distinct pivot values are read by one
    small job unless `pivot_values` lists them.
    """
    if aggfunc not in PIVOT_FUNCTIONS:
        raise ValueError(f"unknown pivot aggregate: {aggfunc!r}")
    indexes, values = _keys(df, index_columns), columns_of(value_column)
    require_columns(df, [pivot_column, *values])
    if pivot_column in indexes:
        raise ValueError("the pivot column cannot be an index column too")
    if aggfunc in ("sum", "mean"):
        require_number(df, values)
    rows = df
    for name in [*indexes, pivot_column]:
        rows = rows.filter(~is_missing(df, name))
    if aggfunc in ("mean", "min", "max"):
        # A pair without any value does not exist for these three.
        present = [~is_missing(df, v) for v in values]
        keep = present[0]
        for test in present[1:]:
            keep = keep | test
        rows = rows.filter(keep)
    if pivot_values is None:
        distinct = rows.select(col(pivot_column).alias("_pivot")).distinct().orderBy("_pivot")
        found = distinct.select(text_of(F.col("_pivot"), type_of(df, pivot_column))).limit(max_values + 1).collect()
        if len(found) > max_values:
            raise ValueError(f"column {pivot_column!r} has more than {max_values} values")
        pivot_values = [row[0] for row in found]
    slots = [f"_v{i}" for i in range(len(values))]
    pairs = rows.groupBy(*[col(i) for i in indexes], to_text(df, pivot_column).alias("_pivot")).agg(
        *[aggregate(df, v, aggfunc).alias(slot) for v, slot in zip(values, slots)]
    )
    # Pairs are unique, so `first` only moves each value to its column.
    wide = pairs.groupBy(*[col(i) for i in indexes]).pivot("_pivot", pivot_values).agg(
        *[F.first(slot).alias(slot) for slot in slots]
    )
    single = isinstance(value_column, str)
    order = values if single else sorted(values)
    picked = [col(i) for i in indexes]
    for value in order:
        slot = slots[values.index(value)]
        for item in pivot_values:
            source = item if len(slots) == 1 else f"{item}_{slot}"
            cell = col(source)
            if fill_value is not None:
                cell = F.coalesce(cell, typed_literal(fill_value, pairs.schema[slot].dataType))
            picked.append(cell.alias(item if single else f"{value} {item}"))
    return wide.select(*picked)
