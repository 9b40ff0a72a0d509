"""Rows: empties, duplicates, missing keys, fill-ins and hidden rows."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import (
    col, columns_of, is_missing, is_present, kind, or_null, require_columns, type_of, typed_literal,
)
from rowmill.operators.windows import visible
from rowmill.plans.hot_ranges import ROWS_PER_TASK, SOURCE_ROW, Order, order_of, sort_columns

HIDDEN = "_hidden"


def remove_empty_rows(df: DataFrame, how: str = "all") -> DataFrame:
    """Drop rows where all, or any, cells are null or NaN; blank text is a value. Names with a leading _ are no cells."""
    if how not in ("all", "any"):
        raise ValueError("how must be all or any")
    missing = [is_missing(df, n) for n in visible(df)]
    empty = reduce((lambda a, b: a & b) if how == "all" else (lambda a, b: a | b), missing)
    return df.filter(~empty)


def remove_duplicates(
    df: DataFrame, subset: list[str] | str | None = None, keep: str | bool = "first",
    order_columns: list[str] | str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per key: the first or last in row order (keep=False: only keys without copies).

    The key is the subset, or all columns without a leading _. Spark limits each key to one row
    before the shuffle, so a key with many copies stays cheap.
    """
    if keep not in (False, "first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    keys = columns_of(subset) or visible(df)
    require_columns(df, keys)
    rest = [n for n in df.columns if n not in keys]
    if keep is False:
        # one row per key is carried along and kept if it is the only one
        carried = [F.any_value(F.struct(*[col(n) for n in rest])).alias("_rest")] if rest else []
        counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_copies"), *carried).filter("_copies = 1")
        return counted.select(*[F.col("_rest")[n].alias(n) if n in rest else col(n) for n in df.columns])
    if not rest or not columns_of(subset) and SOURCE_ROW not in df.columns:
        return df.dropDuplicates(keys)
    order = [Order(o.column, keep == "first") for o in order_of(df, order_columns, "remove_duplicates")]
    window = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(df, order))
    return df.withColumn("_place", F.row_number().over(window)).filter(F.col("_place") == 1).drop("_place")


def drop_rows_missing_keys(df: DataFrame, columns: list[str] | str, require: str = "any") -> DataFrame:
    """Keep rows where any, or all, of the key columns hold something visible."""
    names = columns_of(columns)
    if not names:
        raise ValueError("name at least one key column")
    if require not in ("any", "all"):
        raise ValueError("require must be any or all")
    present = [is_present(df, n) for n in names]
    return df.filter(reduce((lambda a, b: a | b) if require == "any" else (lambda a, b: a & b), present))


def fill_missing_values(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """A constant per column in place of null and NaN; blank text stays."""
    if not values:
        raise ValueError("name at least one column to fill")
    filled = {}
    for name, value in values.items():
        data_type = type_of(df, name)
        if isinstance(data_type, T.IntegralType) and isinstance(value, float) and not value.is_integer():
            filled[name] = F.coalesce(col(name).cast("double"), F.lit(value))
            continue
        if kind(data_type) == "other" and value is not None:
            raise TypeError(f"column {name!r} ({data_type.simpleString()}) takes no fill value")
        filled[name] = F.coalesce(or_null(df, name), typed_literal(value, data_type))
    return df.withColumns(filled)


def select_visible_rows(df: DataFrame, hidden_column: str = HIDDEN) -> DataFrame:
    """Rows whose hidden flag is false or null."""
    if hidden_column not in df.columns:
        raise KeyError(f"no hidden-row flag {hidden_column!r}: load the table with source metadata")
    return df.filter(~F.coalesce(col(hidden_column).cast("boolean"), F.lit(False)))
