"""Columns: selecting, ordering, dropping, renaming and retyping them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import (
    col, columns_of, day, fail_if, is_present, kind, or_null, require_columns, strip, to_number,
    to_text, to_timestamp, type_of,
)

# Words read as booleans.
TRUE_WORDS = ["true", "1", "yes", "y", "예", "네", "참"]
FALSE_WORDS = ["false", "0", "no", "n", "아니오", "아니요", "거짓"]

# Strftime directives and the Spark datetime letters for them.
DATE_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "[SSSSSS][SSS]",
    "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "D",
}


def select_columns(df: DataFrame, columns: list[str] | str) -> DataFrame:
    """Keep the listed columns, in that order."""
    names = columns_of(columns)
    require_columns(df, names)
    return df.select(*[col(n) for n in names])


def reorder_columns(df: DataFrame, columns: list[str] | str, keep_remaining: bool = True) -> DataFrame:
    """Listed columns first; the rest follow in their old order, or are dropped."""
    first = columns_of(columns)
    rest = [n for n in df.columns if n not in first] if keep_remaining else []
    return select_columns(df, first + rest)


def drop_columns(df: DataFrame, columns: list[str] | str) -> DataFrame:
    names = columns_of(columns)
    require_columns(df, names)
    if not names:
        raise ValueError("name at least one column to drop")
    if len(set(names)) >= len(df.columns):
        raise ValueError("all columns would be dropped")
    return df.drop(*names)


def normalize_column_names(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns; where the new name exists already, fill its nulls from the old one."""
    require_columns(df, list(mapping))
    for old, new in mapping.items():
        if old == new:
            continue
        if new not in df.columns:
            df = df.withColumnRenamed(old, new)
            continue
        left, right = type_of(df, new), type_of(df, old)
        if left == right or kind(left) == kind(right):
            merged = F.coalesce(or_null(df, new), or_null(df, old))
        else:
            merged = F.coalesce(to_text(df, new), to_text(df, old))
        df = df.withColumn(new, merged).drop(old)
    return df


def _spark_pattern(date_format: str) -> str:
    """A strftime pattern in Spark's datetime letters."""
    pattern, i = "", 0
    while i < len(date_format):
        letter = date_format[i]
        if letter == "%" and i + 1 < len(date_format):
            i += 1
            directive = date_format[i]
            if directive == "%":
                pattern += "%"
            elif directive in DATE_DIRECTIVES:
                pattern += DATE_DIRECTIVES[directive]
            else:
                raise ValueError(f"unsupported date directive: %{directive}")
        elif letter == "'":
            pattern += "''"
        else:
            pattern += f"'{letter}'" if letter.isalpha() or letter in "[]{}#" else letter
        i += 1
    return pattern


def _boolean(df: DataFrame, column: str) -> Column:
    word = F.lower(strip(to_text(df, column)))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def _moment(df: DataFrame, column: str, date_format: str | None) -> Column:
    if date_format is None:
        return to_timestamp(df, column)
    if kind(type_of(df, column)) == "datetime":
        return to_timestamp(df, column)
    parsed = F.try_to_timestamp(strip(to_text(df, column)), F.lit(_spark_pattern(date_format)))
    return parsed.cast("timestamp_ntz")


def convert_column_type(
    df: DataFrame, column: str, target_type: str, errors: str = "raise", date_format: str | None = None,
) -> DataFrame:
    """Turn a column into number, datetime, date, string or boolean.

    With errors="raise" a present value that cannot be converted fails the job
    when it is computed; with "coerce" it becomes null.
    """
    if errors not in ("raise", "coerce"):
        raise ValueError("errors must be 'raise' or 'coerce'")
    if target_type == "number":
        converted = to_number(df, column)
    elif target_type == "datetime":
        converted = _moment(df, column, date_format)
    elif target_type == "date":
        converted = day(_moment(df, column, date_format))
    elif target_type == "string":
        return df.withColumn(column, to_text(df, column))
    elif target_type == "boolean":
        converted = _boolean(df, column)
    else:
        raise ValueError(f"unknown target type: {target_type!r}")
    if errors == "raise":
        # A blank text is an empty number or date, but it is no boolean word.
        given = col(column).isNotNull() if target_type == "boolean" else is_present(df, column)
        converted = fail_if(given & converted.isNull(), f"column {column} has a value that is not a {target_type}", converted)
    return df.withColumn(column, converted)
