"""Text: cleaning, replacing, extracting, splitting and joining."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import (
    SPACE, col, columns_of, is_present, kind, literal_kind, regex_literal, require_columns,
    to_text, type_of, typed_literal,
)
from rowmill.functions.columns import strip as strip_space

# Above this size a replacement map is joined instead of written as CASE branches; both give the same.
CASE_LIMIT = 50


def normalize_text(
    df: DataFrame, columns: list[str] | str, strip: bool = True, collapse_whitespace: bool = True,
    case: str = "preserve",
) -> DataFrame:
    """Trim, squeeze white space and set the case; null stays null."""
    if case not in ("preserve", "lower", "upper"):
        raise ValueError("case must be preserve, lower or upper")
    for name in columns_of(columns):
        text = to_text(df, name)
        if collapse_whitespace:
            text = F.regexp_replace(text, f"(?U){SPACE}+", " ")
        if strip:  # squeezed white space is one blank
            text = F.trim(text) if collapse_whitespace else strip_space(text)
        if case != "preserve":
            text = F.lower(text) if case == "lower" else F.upper(text)
        df = df.withColumn(name, text)
    return df


def replace_values(df: DataFrame, column: str, replacements: dict[Any, Any]) -> DataFrame:
    """Swap whole values. The map is applied once, so a→b and b→c leaves a as b."""
    data_type = type_of(df, column)
    what = kind(data_type)
    fits = {
        "number": ("number", "boolean"), "text": ("text",), "boolean": ("boolean",), "datetime": ("datetime", "text"),
    }.get(what, ())
    pairs = [(old, new) for old, new in replacements.items() if old is None or literal_kind(old) in fits]
    if not pairs:
        return df
    # An integer column that receives fractions becomes a double column.
    if what == "number" and any(isinstance(new, float) for _, new in pairs) and isinstance(data_type, T.IntegralType):
        data_type = T.DoubleType()
    current = col(column).cast(data_type)
    if len(pairs) <= CASE_LIMIT:
        result = None
        for old, new in pairs:
            test = col(column).isNull() if old is None else col(column) == typed_literal(old, type_of(df, column))
            value = typed_literal(new, data_type)
            result = F.when(test, value) if result is None else result.when(test, value)
        return df.withColumn(column, result.otherwise(current))
    entries = F.array(*[
        F.struct(typed_literal(old, type_of(df, column)).alias("_old"), typed_literal(new, data_type).alias("_new")) for old, new in pairs
    ])
    table = df.sparkSession.range(1).select(F.inline(entries)).withColumn("_hit", F.lit(True))
    joined = df.join(table, col(column).eqNullSafe(F.col("_old")), "left")  # Spark knows the table's size
    value = F.when(F.col("_hit"), F.col("_new")).otherwise(current)
    return joined.withColumn(column, value).drop("_old", "_new", "_hit")


def replace_text(df: DataFrame, column: str, old: str, new: str = "", case_sensitive: bool = True) -> DataFrame:
    """Replace a literal piece of text everywhere; other column types pass through."""
    if not old:
        raise ValueError("the text to look for is empty")
    if kind(type_of(df, column)) != "text":
        return df
    if case_sensitive:
        replaced = F.replace(col(column), F.lit(old), F.lit(new))
    else:
        safe = new.replace("\\", "\\\\").replace("$", "\\$")
        replaced = F.regexp_replace(col(column), "(?iu)" + regex_literal(old), safe)
    return df.withColumn(column, replaced)


def _after_first(text: Column, mark: str) -> Column:
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark)))


def _before_first(text: Column, mark: str) -> Column:
    return F.substring_index(text, mark, 1)


def _after_last(text: Column, mark: str) -> Column:
    return F.when(text.contains(mark), F.substring_index(text, mark, -1))


def _before_last(text: Column, mark: str) -> Column:
    tail = F.length(F.substring_index(text, mark, -1)) + len(mark)
    return F.when(text.contains(mark), F.substr(text, F.lit(1), F.length(text) - tail)).otherwise(text)


def extract_text(
    df: DataFrame, column: str, result_column: str, mode: str, delimiter: str | None = None,
    length: int | None = None, start_delimiter: str | None = None, end_delimiter: str | None = None,
    occurrence: str = "first",
) -> DataFrame:
    """Part of a text: before/after/between delimiters, or the left/right characters.

    Without the delimiter, `before` gives the whole text and the others null.
    """
    if occurrence not in ("first", "last"):
        raise ValueError("occurrence must be first or last")
    text = to_text(df, column)
    if mode in ("left", "right"):
        if isinstance(length, bool) or not isinstance(length, int) or length < 1:
            raise ValueError(f"{mode} needs a length of at least 1")
        part = F.left(text, F.lit(length)) if mode == "left" else F.right(text, F.lit(length))
    elif mode in ("before", "after"):
        if not delimiter:
            raise ValueError(f"{mode} needs a delimiter")
        cut = {
            ("before", "first"): _before_first, ("before", "last"): _before_last,
            ("after", "first"): _after_first, ("after", "last"): _after_last,
        }[mode, occurrence]
        part = cut(text, delimiter)
    elif mode == "between":
        if not start_delimiter or not end_delimiter:
            raise ValueError("between needs a start and an end delimiter")
        part = _before_first(_after_first(text, start_delimiter), end_delimiter)
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    return df.withColumn(result_column, part)


def split_column(
    df: DataFrame, column: str, result_columns: list[str], delimiter: str, drop_source: bool = False,
) -> DataFrame:
    """Split at a literal delimiter; the last column takes the rest, missing parts are null."""
    require_columns(df, [column])
    if not delimiter:
        raise ValueError("the delimiter is empty")
    if len(result_columns) < 2 or len(set(result_columns)) != len(result_columns):
        raise ValueError("at least two different result columns are needed")
    taken = [n for n in result_columns if n in df.columns]
    if taken:
        raise ValueError(f"result columns exist already: {', '.join(taken)}")
    parts = F.split(to_text(df, column), regex_literal(delimiter), len(result_columns))
    df = df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(result_columns)})
    return df.drop(column) if drop_source else df


def combine_columns(
    df: DataFrame, columns: list[str] | str, result_column: str, separator: str = " ", skip_missing: bool = True,
) -> DataFrame:
    """Join values with a separator; blanks are skipped, or written as empty text."""
    names = columns_of(columns)
    if not names:
        raise ValueError("name at least one column to combine")
    parts = [F.when(is_present(df, n), to_text(df, n)) for n in names]
    if not skip_missing:
        parts = [F.coalesce(p, F.lit("")) for p in parts]
    return df.withColumn(result_column, F.concat_ws(separator, *parts))
