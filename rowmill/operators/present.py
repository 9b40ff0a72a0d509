"""Presentation decisions as columns: highlights, display formats, colour scales.

Painting a cell is the viewer's work; which rows, which columns and which
colour is decided here. Matching rows get a colour name in `highlight`; where
only some columns are meant, `_highlight_targets` lists them.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    col, columns_of, fail_if, is_missing, is_present, require_columns, to_double, to_timestamp,

)
from rowmill.functions.predicates import as_flag, predicate
from rowmill.operators.numeric import rounded
from rowmill.operators.sorting import top_order
from rowmill.operators.windows import number_rows
from rowmill.plans.hot_ranges import ROWS_PER_TASK
from rowmill.plans.selection import medians, nth_value

# Colours, display formats and colour scales.
COLORS = {"red": "FFC7CE", "yellow": "FFEB9C", "green": "C6EFCE", "blue": "BDD7EE", "gray": "D9E1F2"}
NUMBER_FORMATS = {
    "currency": ("₩", "#,##0", "", 0),
    "thousands": ("", "#,##0", "", 0),
    "percent": ("", "0.00", "%", 2),
    "percent_points": ("", "0.00", "%", 2),
    "decimal_0": ("", "0", "", 0),
    "decimal_1": ("", "0.0", "", 1),
    "decimal_2": ("", "0.00", "", 2),
    "decimal_3": ("", "0.000", "", 3),
    "decimal_4": ("", "0.0000", "", 4),
}
DATE_FORMATS = {"date": "yyyy-MM-dd", "datetime": "yyyy-MM-dd HH:mm:ss"}
PALETTES = {
    "red_yellow_green": ("F8696B", "FFEB84", "63BE7B"),
    "blue_white": ("5B9BD5", "FFFFFF", "DDEBF7"),
    "green_white": ("70AD47", "FFFFFF", "E2F0D9"),
}
EXTREMES = ("max", "min", "top_n", "bottom_n")

HIGHLIGHT, TARGETS = "highlight", "_highlight_targets"


def _check(df: DataFrame, columns: list[str], color: str) -> None:
    require_columns(df, columns)
    if not columns:
        raise ValueError("name at least one column")
    hidden = [n for n in columns if n.startswith("_")]
    if hidden:
        raise ValueError(f"internal columns are dropped on save and take no highlight: {', '.join(hidden)}")
    if color not in COLORS:
        raise ValueError(f"unknown colour: {color!r}")


def _paint(df: DataFrame, test: Column, color: str, targets: Column | None) -> DataFrame:
    """Colour where the test holds; a later highlight replaces an earlier one in its rows."""
    earlier = F.col(HIGHLIGHT) if HIGHLIGHT in df.columns else F.lit(None).cast("string")
    changes = {HIGHLIGHT: F.when(test, F.lit(color)).otherwise(earlier)}
    if targets is not None or TARGETS in df.columns:
        empty = F.lit(None).cast("array<string>")
        before = F.col(TARGETS) if TARGETS in df.columns else empty
        changes[TARGETS] = F.when(test, empty if targets is None else targets).otherwise(before)
    return df.withColumns(changes)


def _names(columns: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in columns])


def highlight_rows(
    df: DataFrame, column: str, operator: str, value: Any, color: str, target_columns: list[str] | str | None = None,
) -> DataFrame:
    """Rows that meet a condition, as a whole or in the target columns."""
    targets = columns_of(target_columns)
    _check(df, targets or [n for n in df.columns if not n.startswith("_")], color)
    return _paint(df, as_flag(predicate(df, column, operator, value)), color, _names(targets) if targets else None)


def highlight_extremes(
    df: DataFrame, column: str, mode: str, color: str, n: int = 1, include_ties: bool = True,
    order_columns: list[str] | str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Largest or smallest values of a column.

    The limit of a list is found by counting, so no task receives the list. Without ties
    exactly n rows are marked, the first ones in row order; `order_columns` must then
    tell rows apart.
    """
    _check(df, [column], color)
    if mode not in EXTREMES:
        raise ValueError(f"unknown mode: {mode!r}")
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a whole number of at least 1")
    value = to_double(df, column)
    numbers = df.withColumn("_number", value).filter(F.col("_number").isNotNull())
    largest = mode in ("max", "top_n")
    message = f"column {column} has no numbers to highlight"
    if mode in ("max", "min"):
        limit = numbers.agg((F.max if largest else F.min)("_number")).scalar()
        test = fail_if(limit.isNull(), message, value == limit)
        return _paint(df, as_flag(test), color, _names([column]))
    order = top_order(numbers, "_number", largest, order_columns)
    if not include_ties and len(order) < 2:
        raise ValueError("without ties the marked rows depend on row order: give order_columns")
    limit = nth_value(numbers, "_number", n, largest).select("_value").scalar()
    within = as_flag(fail_if(limit.isNull(), message, value >= limit if largest else value <= limit))
    if include_ties:
        return _paint(df, within, color, _names([column]))
    # rows within the limit are n and those that tie with the last; row order decides among them
    marked = df.withColumns({"_number": value, "_within": within})
    numbered = number_rows(marked, [], order, F.col("_within"), "_nth", rows_per_task)
    return _paint(numbered, as_flag(F.col("_nth") <= n), color, _names([column])).drop("_number", "_within", "_nth")


def highlight_missing(df: DataFrame, columns: list[str] | str, color: str) -> DataFrame:
    """Blank cells of the listed columns."""
    names = columns_of(columns)
    _check(df, names, color)
    blanks = F.array_compact(F.array(*[F.when(~is_present(df, n), F.lit(n)) for n in names]))
    return _paint(df, F.size(blanks) > 0, color, blanks)


def _formatted(df: DataFrame, column: str, name: str) -> Column:
    if name in DATE_FORMATS:
        return F.date_format(to_timestamp(df, column), DATE_FORMATS[name])
    prefix, pattern, suffix, decimals = NUMBER_FORMATS[name]
    number = to_double(df, column) * (100.0 if name == "percent" else 1.0)
    shown = rounded(number, decimals) + F.lit(0.0)  # no negative zero
    size = F.call_function("format_number", F.abs(shown), F.lit(pattern))
    return F.concat(F.when(shown < 0, F.lit("-")).otherwise(F.lit("")), F.lit(prefix), size, F.lit(suffix))


def format_numbers(df: DataFrame, columns: list[str] | str, format: str) -> DataFrame:
    """Display text of numbers or dates in `<column>_fmt`."""
    names = columns_of(columns)
    require_columns(df, names)
    if not names:
        raise ValueError("name at least one column")
    if format not in NUMBER_FORMATS and format not in DATE_FORMATS:
        raise ValueError(f"unknown display format: {format!r}")
    return df.withColumns({f"{n}_fmt": _formatted(df, n, format) for n in names})


def _blend(low: str, high: str, share: Column) -> Column:
    channels = []
    for i in (0, 2, 4):
        a, b = int(low[i : i + 2], 16), int(high[i : i + 2], 16)
        channels.append(F.lpad(F.hex(F.floor(F.lit(float(a)) + (b - a) * share + 0.5)), 2, "0"))
    return F.concat(*channels)


def color_scale(
    df: DataFrame, column: str, palette: str, position_column: str | None = None, color_column: str | None = None,
) -> DataFrame:
    """Place of each value between minimum (-1), median (0) and maximum (1), with its colour."""
    require_columns(df, [column])
    if palette not in PALETTES:
        raise ValueError(f"unknown palette: {palette!r}")
    value = to_double(df, column)
    numbers = df.select(value.alias("_number"))
    ends = [F.min("_number").alias("low"), F.max("_number").alias("high")]
    stats = numbers.agg(F.struct(*ends)).scalar()
    low, high = stats["low"], stats["high"]
    middle = medians(numbers, None, {"middle": "_number"}).scalar()
    below = F.try_divide(value - middle, middle - low)
    above = F.try_divide(value - middle, high - middle)
    position = F.coalesce(F.when(value <= middle, below).otherwise(above), F.when(value.isNotNull(), F.lit(0.0)))
    position = fail_if(low.isNull(), f"column {column} has no numbers for a colour scale", position)
    place, shade = position_column or f"{column}_scale", color_column or f"{column}_color"
    df = df.withColumn(place, position)
    start, mid, end = PALETTES[palette]
    color = F.when(col(place) <= 0, _blend(mid, start, -col(place))).otherwise(_blend(mid, end, col(place)))
    return df.withColumn(shade, color)
