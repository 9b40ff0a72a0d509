"""Dates: parts, differences, and filters by relative or calendar period."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import (
    checked_timestamp, col, columns_of, kind, parse_moment, to_timestamp, type_of,
)

PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth,
    "weekday": lambda c: F.weekday(c) + 1,
}
PERIODS = ("today", "last_n_days", "older_than_n_days", "this_month", "last_month", "this_year", "last_year")


def add_date_parts(df: DataFrame, column: str, parts: list[str] | str, result_prefix: str | None = None) -> DataFrame:
    """year, quarter, month, ISO week, day and weekday (Monday = 1) as new columns."""
    names = columns_of(parts)
    unknown = [p for p in names if p not in PARTS]
    if unknown or not names:
        raise ValueError(f"unknown date parts: {unknown}" if unknown else "name at least one date part")
    prefix = column if result_prefix is None else result_prefix
    moment = to_timestamp(df, column)
    return df.withColumns({f"{prefix}_{p}": PARTS[p](moment) for p in names})


def _today(today: Any) -> Column:
    """Today's date: a literal when given, else the date of the running query."""
    return F.current_date() if today is None else F.lit(parse_moment(today).date())


def calculate_date_difference(
    df: DataFrame, start_column: str, end_column: str | None = None, result_column: str = "date_difference",
    end_mode: str = "column", unit: str = "days", absolute: bool = False, today: Any = None,
) -> DataFrame:
    """End minus start in days, weeks or completed months, as a double."""
    if end_mode not in ("column", "today"):
        raise ValueError("end_mode must be column or today")
    if (end_mode == "column") != bool(end_column):
        raise ValueError("end_column belongs to end_mode='column', and is needed there")
    if unit not in ("days", "weeks", "months"):
        raise ValueError("unit must be days, weeks or months")
    purpose = "date difference"
    start = checked_timestamp(df, start_column, purpose)
    end = checked_timestamp(df, end_column, purpose) if end_column else _today(today).cast("timestamp_ntz")
    if unit == "months":
        early, late = F.least(start, end), F.greatest(start, end)
        count = (
            (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early)
            - (F.dayofmonth(late) < F.dayofmonth(early)).cast("int")
        )
        both = start.isNotNull() & end.isNotNull()
        signed = count if absolute else F.when(end >= start, count).otherwise(-count)
        result = F.when(both, signed.cast("double"))
    else:
        result = F.datediff(end, start).cast("double")
        result = F.abs(result) if absolute else result
        result = result / 7 if unit == "weeks" else result
    return df.withColumn(result_column, result)


def _within(df: DataFrame, column: str, start: Column | None, end: Column, purpose: str) -> DataFrame:
    """Rows with start <= column < end, dates given as date columns.

    A date or timestamp column is compared as it is, so the range reaches the
    scan; text has to be parsed first.
    """
    data_type = type_of(df, column)
    if kind(data_type) == "datetime":
        value, target = col(column), data_type
    else:
        value, target = checked_timestamp(df, column, purpose), T.TimestampNTZType()
    test = value < end.cast(target)
    return df.filter(test if start is None else (value >= start.cast(target)) & test)


def filter_relative_dates(
    df: DataFrame, column: str, period: str, days: int | None = None, today: Any = None,
) -> DataFrame:
    """Rows whose date part falls into a period counted from today."""
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period!r}")
    counted = period in ("last_n_days", "older_than_n_days")
    if counted and (isinstance(days, bool) or not isinstance(days, int) or days < 1):
        raise ValueError(f"{period} needs days of at least 1")
    if not counted and days is not None:
        raise ValueError(f"{period} takes no days")
    now = _today(today)
    month, year = F.trunc(now, "month"), F.trunc(now, "year")
    start, end = {
        "today": lambda: (now, F.date_add(now, 1)),
        "last_n_days": lambda: (F.date_sub(now, days - 1), F.date_add(now, 1)),
        "older_than_n_days": lambda: (None, F.date_sub(now, days)),
        "this_month": lambda: (month, F.add_months(month, 1)),
        "last_month": lambda: (F.add_months(month, -1), month),
        "this_year": lambda: (year, F.add_months(year, 12)),
        "last_year": lambda: (F.add_months(year, -12), year),
    }[period]()
    return _within(df, column, start, end, "relative date filter")


def filter_calendar_period(
    df: DataFrame, column: str, year: int, half: int | None = None, quarter: int | None = None,
) -> DataFrame:
    """Rows of a named year, half-year (1, 2) or quarter (1..4), last day included."""
    if half is not None and quarter is not None:
        raise ValueError("give half or quarter, not both")
    if half not in (None, 1, 2) or quarter not in (None, 1, 2, 3, 4):
        raise ValueError("half is 1 or 2, quarter is 1 to 4")
    months = 12 if half is None and quarter is None else 6 if half else 3
    first = ((half or quarter or 1) - 1) * months
    start = dt.date(year, first + 1, 1)
    after = first + months
    end = dt.date(year + after // 12, after % 12 + 1, 1)
    return _within(df, column, F.lit(start), F.lit(end), "calendar filter")
