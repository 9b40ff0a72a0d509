"""Row filters and the two-valued conditional column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import literal_kind, parse_moment
from rowmill.functions.predicates import as_flag, nested, predicate


def filter_rows(df: DataFrame, column: str, operator: str, value: Any) -> DataFrame:
    """Rows that meet one condition."""
    return df.filter(predicate(df, column, operator, value))


def filter_by_conditions(
    df: DataFrame, conditions: list[dict[str, Any]] | None = None, logic: str = "and",
    condition_groups: list[dict[str, Any]] | None = None, group_logic: str = "or",
) -> DataFrame:
    """Rows that meet a flat or grouped list of conditions."""
    return df.filter(nested(df, conditions, logic, condition_groups, group_logic))


def add_conditional_column(
    df: DataFrame, result_column: str, conditions: list[dict[str, Any]] | None = None, true_value: Any = None,
    false_value: Any = None, logic: str = "and", condition_groups: list[dict[str, Any]] | None = None,
    group_logic: str = "or",
) -> DataFrame:
    """One of two values per row, by conditions. Both values must be of one kind."""
    kinds = {literal_kind(true_value), literal_kind(false_value)} - {"null"}
    if len(kinds) > 1:
        raise TypeError(f"{true_value!r} and {false_value!r} cannot share a column")
    test = as_flag(nested(df, conditions, logic, condition_groups, group_logic))
    if kinds == {"datetime"}:
        values = [
            F.lit(None if v is None else parse_moment(v).isoformat(sep=" ")).cast("timestamp_ntz")
            for v in (true_value, false_value)
        ]
    elif not kinds:
        values = [F.lit(None).cast("string")] * 2
    else:
        values = [F.lit(true_value), F.lit(false_value)]
    return df.withColumn(result_column, F.when(test, values[0]).otherwise(values[1]))
