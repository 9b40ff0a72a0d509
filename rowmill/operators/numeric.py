"""Numbers: reading formatted text, rounding, arithmetic and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    columns_of, fail_if, is_present, kind, parse_number, strip, to_double, to_number, to_text, type_of,
)

# What formatted numbers may carry.
CURRENCY_CODES = ["KRW", "USD", "EUR", "JPY"]
CURRENCY_SUFFIX = "원"
IGNORED_CHARACTERS = ", ₩$€£¥"

# Doubles from here on are whole numbers, and floor/ceil on them would leave the BIGINT range.
EXACT_LIMIT = float(2**53)


def _read_formatted(text: Column, percent_as_fraction: bool) -> Column:
    """Number in a formatted text, null when there is none."""
    text = strip(text)
    bracketed = text.rlike(r"(?s)^\(.*\)$")
    inner = F.when(bracketed, strip(F.substr(text, F.lit(2), F.length(text) - 2))).otherwise(text)
    percent = inner.endswith("%")
    inner = strip(F.regexp_replace(inner, "%$", ""))
    inner = F.regexp_replace(inner, rf"(?iU)^(?:{'|'.join(CURRENCY_CODES)})\s*", "")
    inner = F.regexp_replace(inner, rf"(?U)\s*{CURRENCY_SUFFIX}$", "")
    number = parse_number(F.translate(inner, IGNORED_CHARACTERS, ""))
    number = F.when(bracketed, -F.abs(number)).otherwise(number)
    return F.when(percent, number / 100).otherwise(number) if percent_as_fraction else number


def _only_symbols(text: Column) -> Column:
    """Nothing is left once the decoration is removed: no number, and no error either."""
    bare = F.regexp_replace(text, rf"(?iU)[\s()%{IGNORED_CHARACTERS}]|{CURRENCY_SUFFIX}|{'|'.join(CURRENCY_CODES)}", "")
    return bare == ""


def clean_numeric_values(
    df: DataFrame, columns: list[str] | str, errors: str = "raise", percent_as_fraction: bool = False,
) -> DataFrame:
    """Read `1,200`, `₩3,000`, `(450)`, `USD 20`, `5원` or `12.5%` as numbers."""
    if errors not in ("raise", "coerce"):
        raise ValueError("errors must be 'raise' or 'coerce'")
    for name in columns_of(columns):
        if kind(type_of(df, name)) == "number":
            continue
        text = to_text(df, name)
        number = _read_formatted(text, percent_as_fraction)
        if errors == "raise":
            bad = is_present(df, name) & number.isNull() & ~_only_symbols(text)
            number = fail_if(bad, f"column {name} has a value that is not a number", number)
        df = df.withColumn(name, number)
    return df


def whole(value: Column, rounder) -> Column:
    """floor or ceil of a double, kept as a double of any size."""
    return F.when(F.abs(value) < EXACT_LIMIT, rounder(value).cast("double")).otherwise(value)


def rounded(value: Column, decimals: int, mode: str = "round") -> Column:
    factor = F.lit(10.0**decimals)
    scaled = value * factor
    if mode == "round":
        units = F.signum(scaled) * whole(F.abs(scaled) + 0.5, F.floor)
    else:
        units = whole(scaled, F.floor if mode == "floor" else F.ceil)
    return units / factor


def round_numbers(df: DataFrame, columns: list[str] | str, decimals: int = 0, mode: str = "round") -> DataFrame:
    """Half away from zero, down or up, at a number of decimals from -10 to 10."""
    if mode not in ("round", "floor", "ceil"):
        raise ValueError("mode must be round, floor or ceil")
    if isinstance(decimals, bool) or not isinstance(decimals, int) or abs(decimals) > 10:
        raise ValueError("decimals must be a whole number from -10 to 10")
    for name in columns_of(columns):
        value = to_double(df, name)
        if kind(type_of(df, name)) == "text":
            bad = is_present(df, name) & value.isNull()
            value = fail_if(bad, f"column {name} has a value that is not a number", value)
        df = df.withColumn(name, rounded(value, decimals, mode))
    return df


def calculate_column(
    df: DataFrame, result_column: str, operator: str, left_column: str,
    right_column: str | None = None, value: float | int | None = None,
) -> DataFrame:
    """Arithmetic of a column with another column or a constant; x/0 is null."""
    if (right_column is None) == (value is None):
        raise ValueError("give either right_column or value")
    left = to_number(df, left_column)
    right = to_number(df, right_column) if right_column is not None else F.lit(value)
    if operator == "add":
        result = left + right
    elif operator == "subtract":
        result = left - right
    elif operator == "multiply":
        result = left * right
    elif operator == "divide":
        result = F.try_divide(left.cast("double"), right.cast("double"))
    elif operator == "percent_of":
        result = F.try_divide(left.cast("double"), right.cast("double")) * 100
    elif operator == "absolute_difference":
        result = F.abs(left - right)
    else:
        raise ValueError(f"unknown operator: {operator!r}")
    return df.withColumn(result_column, result)


def compare_columns(
    df: DataFrame, left_column: str, right_column: str, difference_column: str = "difference",
    match_column: str = "matches", tolerance: float = 0.0,
) -> DataFrame:
    """Difference of two columns, and whether it stays within the tolerance."""
    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)) or tolerance < 0:
        raise ValueError("tolerance must be a number of at least 0")
    difference = to_number(df, left_column) - to_number(df, right_column)
    within = F.coalesce(F.abs(difference) <= F.lit(float(tolerance)), F.lit(False))
    return df.withColumns({difference_column: difference, match_column: within})
