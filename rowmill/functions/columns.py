"""Column expressions shared by every operator.

Three notions of "no value" are kept apart:

* missing      null, or NaN in a floating-point column
* blank        missing, or text made of white space only
* unparseable  present, but not a number / not a date

Everything here is a native Spark expression; nothing runs in Python per row.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"(?U)[^\s\x1C-\x1F]"

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INFINITY = r"(?i)^[+-]?inf(inity)?$"
_DATE = r"^([0-9]{4}-[0-9]{1,2}(-[0-9]{1,2}([ T].*)?)?|(1[7-9]|2[0-2])[0-9]{2})$"


def columns_of(value: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """Accept one column name or a list of them."""
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_columns(df: DataFrame, names: list[str]) -> None:
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise KeyError(f"no such column: {', '.join(absent)}")


def type_of(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    return df.schema[name].dataType


def kind(data_type: T.DataType) -> str:
    """number, text, boolean, datetime or other."""
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DoubleType, T.FloatType))


def require_number(df: DataFrame, names: list[str]) -> None:
    for name in names:
        if kind(type_of(df, name)) != "number":
            raise TypeError(f"column {name!r} must be numeric, it is {type_of(df, name).simpleString()}")


# ---------------------------------------------------------------- presence


def is_missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return (c.isNull() | F.isnan(c)) if is_floating(type_of(df, name)) else c.isNull()


def is_present(df: DataFrame, name: str) -> Column:
    """Never null: true where the cell holds something visible."""
    c = col(name)
    data_type = type_of(df, name)
    if kind(data_type) == "text":
        return c.isNotNull() & F.coalesce(c.rlike(NOT_SPACE), F.lit(False))
    if is_floating(data_type):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def or_null(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null."""
    c = col(name)
    return F.nanvl(c, F.lit(None).cast(type_of(df, name))) if is_floating(type_of(df, name)) else c


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


# --------------------------------------------------------------- numbers


def parse_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = strip(c)
    return F.when(text.rlike(_NUMBER) | text.rlike(_INFINITY), text.try_cast("double"))


def to_number(df: DataFrame, name: str) -> Column:
    """Numeric view of any column; unparseable values are null."""
    data_type = type_of(df, name)
    what = kind(data_type)
    if what == "number":
        if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType)):
            return col(name).cast("long")
        if isinstance(data_type, T.FloatType):
            return F.nanvl(col(name), F.lit(None).cast("float")).cast("double")
        return or_null(df, name)
    if what == "text":
        return parse_number(col(name))
    if what == "boolean":
        return col(name).cast("int").cast("long")
    raise TypeError(f"column {name!r} cannot be read as numbers")


def to_double(df: DataFrame, name: str) -> Column:
    return to_number(df, name).cast("double")


# ----------------------------------------------------------------- dates


def parse_timestamp(c: Column) -> Column:
    """Text to timestamp without time zone; ISO and common numeric layouts."""
    text = strip(c)
    text = F.regexp_replace(text, r"^([0-9]{4})[/.]([0-9]{1,2})(?:[/.]([0-9]{1,2}))(?=$|[ T])", "$1-$2-$3")
    text = F.regexp_replace(text, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?=$|[ T])", "$3-$1-$2")
    text = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return F.when(text.rlike(_DATE), text.try_cast("timestamp_ntz"))


def to_timestamp(df: DataFrame, name: str) -> Column:
    """Timestamp view of a date, timestamp or text column; unparseable is null."""
    data_type = type_of(df, name)
    what = kind(data_type)
    if what == "datetime":
        return col(name).cast("timestamp_ntz")
    if what == "text":
        return parse_timestamp(col(name))
    raise TypeError(f"column {name!r} cannot be read as dates, it is {data_type.simpleString()}")


def checked_timestamp(df: DataFrame, name: str, purpose: str) -> Column:
    """As to_timestamp, but a present value that is not a date fails the job."""
    parsed = to_timestamp(df, name)
    if kind(type_of(df, name)) == "datetime":
        return parsed
    return fail_if(is_present(df, name) & parsed.isNull(), f"{purpose}: column {name} holds a value that is not a date", parsed)


def day(c: Column) -> Column:
    """The moment with its time cut to midnight."""
    return c.cast("date").cast("timestamp_ntz")


def parse_moment(value: Any) -> dt.datetime:
    """A literal given by the user as date, datetime or text."""
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        text = value.strip().replace("/", "-").replace(".", "-", 2) if value.strip()[:4].isdigit() else value.strip()
        parts = text.split("-")
        if len(parts) == 2:
            text += "-01"
        elif len(parts) == 1 and len(text) == 4:
            text += "-01-01"
        return dt.datetime.fromisoformat(text).replace(tzinfo=None)
    raise TypeError(f"not a date: {value!r}")


def moment_literal(value: Any, data_type: T.DataType) -> Column:
    """A literal of the column's own type, so that comparisons are pushed to the scan."""
    moment = parse_moment(value)
    if isinstance(data_type, T.DateType) and moment.time() == dt.time():
        return F.lit(moment.date())
    target = "timestamp" if isinstance(data_type, T.TimestampType) else "timestamp_ntz"
    return F.lit(moment.isoformat(sep=" ")).cast(target)


# ------------------------------------------------------------------ text


def _double_text(c: Column) -> Column:
    """Shortest decimal form, with an exponent only from 1e16 and below 1e-4."""
    plain = c.cast("string")
    size = F.abs(c)
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    mantissa = F.ltrim(F.substring_index(plain, "E", 1), F.lit("-"))
    exponent = F.substring_index(plain, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    padded = F.rpad(digits, F.greatest(exponent + 1, F.length(digits)), "0")
    fraction = F.substr(padded, exponent + 2)
    large = F.concat(
        sign, F.substr(padded, F.lit(1), exponent + 1), F.lit("."),
        F.when(fraction == "", F.lit("0")).otherwise(fraction),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    scientific = F.concat(
        sign, F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), "0"),
    )
    return (
        F.when(F.isnan(c), F.lit(None).cast("string"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(~plain.contains("E"), plain)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(scientific)
    )


def text_of(c: Column, data_type: T.DataType) -> Column:
    what = kind(data_type)
    if what == "text":
        return c
    if what == "boolean":
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(data_type, T.DoubleType):
        return _double_text(c)
    if isinstance(data_type, T.FloatType):
        return _double_text(c.cast("double"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"( 00:00:00)?\.000000$", "")
    return c.cast("string")


def to_text(df: DataFrame, name: str) -> Column:
    """Text form of any column; a timestamp at midnight is written as a date."""
    return text_of(col(name), type_of(df, name))


def regex_literal(text: str) -> str:
    """A Java pattern that matches exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# --------------------------------------------------------------- literals


def fail_if(condition: Column, message: str, value: Column) -> Column:
    """`value`, unless the condition holds for the row, which ends the job.

    The check lives inside the expression: it costs no extra pass, and it is
    skipped when a later step drops the column.
    """
    return F.when(condition, F.raise_error(F.lit(message))).otherwise(value)


def literal_kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, Decimal)):
        return "number"
    if isinstance(value, str):
        return "text"
    if isinstance(value, (dt.date, dt.datetime)):
        return "datetime"
    raise TypeError(f"not a scalar value: {value!r}")


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """A literal that fits a column of the given type; raises when it cannot."""
    if value is None:
        return F.lit(None).cast(data_type)
    have, want = literal_kind(value), kind(data_type)
    if want == "datetime" and have in {"datetime", "text"}:
        return moment_literal(value, data_type)
    if want == "text":
        return F.lit(plain_text(value))
    if want == have or (want == "number" and have == "boolean"):
        return F.lit(value).cast(data_type)
    raise TypeError(f"{value!r} does not fit a column of type {data_type.simpleString()}")


def plain_text(value: Any) -> str:
    """Text of a literal, in the form to_text gives to a column value."""
    if isinstance(value, (dt.date, dt.datetime)):
        moment = parse_moment(value)
        return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat(sep=" ")
    return str(value)
