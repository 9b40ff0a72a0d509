"""Condition dictionaries compiled to boolean columns.

A condition is ``{"column": …, "operator": …, "value": …}``. The predicate form
keeps plain comparisons so that Catalyst pushes them to the scan; null counts as
false there because a filter drops null. `as_flag` is the form for values.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    col, is_floating, is_present, kind, literal_kind, moment_literal, plain_text, to_text, type_of,
)

COMPARISONS = ("==", "!=", ">", ">=", "<", "<=")
TEXT_TESTS = ("contains", "startswith", "endswith")
OPERATORS = (*COMPARISONS, *TEXT_TESTS, "is_null", "not_null", "between", "in", "not_in")


def check_condition(operator: str, value: Any) -> None:
    if operator not in OPERATORS:
        raise ValueError(f"unknown condition operator: {operator!r}")
    is_list = isinstance(value, (list, tuple))
    if operator == "between":
        if not is_list or len(value) != 2:
            raise ValueError("between needs a list of two values")
        if any(item is None for item in value):
            raise ValueError("between needs two values that are not null")
    elif operator in ("in", "not_in"):
        if not is_list:
            raise ValueError(f"{operator} needs a list of values")
    elif isinstance(value, (list, tuple, dict, set)):
        raise ValueError(f"{operator} needs a single value")
    elif value is None and operator not in ("is_null", "not_null"):
        raise ValueError("compare with null by is_null or not_null")


def _comparable(df: DataFrame, column: str, value: Any) -> Column | None:
    """The literal in the column's type, or None where the two can never be equal."""
    data_type = type_of(df, column)
    have, want = literal_kind(value), kind(data_type)
    if want == "datetime" and have in ("datetime", "text"):
        return moment_literal(value, data_type)
    if want == have:
        return F.lit(value)
    if want == "number" and have == "boolean":
        return F.lit(int(value))
    if want == "boolean" and have == "number" and value in (0, 1):
        return F.lit(bool(value))
    return None


def _ordered(df: DataFrame, column: str, value: Any) -> Column:
    literal = _comparable(df, column, value)
    if literal is None:
        raise TypeError(
            f"column {column!r} ({type_of(df, column).simpleString()}) cannot be ordered against {value!r}"
        )
    return literal


def _membership(df: DataFrame, column: str, values: list[Any]) -> Column | None:
    literals = [_comparable(df, column, v) for v in values if v is not None]
    known = [item for item in literals if item is not None]
    tests = [col(column).isin(known)] if known else []
    if any(v is None for v in values):
        tests.append(col(column).isNull())
    return reduce(lambda a, b: a | b, tests) if tests else None


def predicate(df: DataFrame, column: str, operator: str, value: Any = None) -> Column:
    """Boolean column that is true exactly for the matching rows (else false or null)."""
    check_condition(operator, value)
    data_type = type_of(df, column)
    c = col(column)
    if operator == "is_null":
        return ~is_present(df, column)
    if operator == "not_null":
        return is_present(df, column)
    if operator in TEXT_TESTS:
        text = c if kind(data_type) == "text" else to_text(df, column)
        return getattr(text, operator)(plain_text(value))
    if operator in ("==", "!="):
        literal = _comparable(df, column, value)
        if operator == "==":
            return F.lit(False) if literal is None else c == literal
        return F.lit(True) if literal is None else ~c.eqNullSafe(literal)
    if operator == "between":
        return c.between(_ordered(df, column, value[0]), _ordered(df, column, value[1]))
    if operator == "in":
        member = _membership(df, column, list(value))
        return F.lit(False) if member is None else member
    if operator == "not_in":
        member = _membership(df, column, list(value))
        if member is None:
            return F.lit(True)
        return c.isNotNull() & ~member if None in value else c.isNull() | ~member
    literal = _ordered(df, column, value)
    test = {">": c > literal, ">=": c >= literal, "<": c < literal, "<=": c <= literal}[operator]
    if is_floating(data_type) and operator in (">", ">="):
        test = test & ~F.isnan(c)  # Spark orders NaN above every number
    return test


def _joined(parts: list[Column], logic: str) -> Column:
    if logic not in ("and", "or"):
        raise ValueError("conditions are joined by 'and' or 'or'")
    if not parts:
        raise ValueError("at least one condition is needed")
    return reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)


def all_of(df: DataFrame, conditions: list[dict[str, Any]], logic: str = "and") -> Column:
    return _joined([predicate(df, c["column"], c["operator"], c.get("value")) for c in conditions], logic)


def nested(
    df: DataFrame,
    conditions: list[dict[str, Any]] | None = None,
    logic: str = "and",
    condition_groups: list[dict[str, Any]] | None = None,
    group_logic: str = "or",
) -> Column:
    """A flat list of conditions, or groups of such lists; exactly one of the two."""
    if bool(conditions) == bool(condition_groups):
        raise ValueError("give either conditions or condition_groups")
    if conditions:
        return all_of(df, conditions, logic)
    groups = [all_of(df, g.get("conditions") or [], g.get("logic", "and")) for g in condition_groups or []]
    return _joined(groups, group_logic)


def as_flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))
