"""Column types of text files, from all their cells.

A type is chosen where every filled cell of a column reads as one: whole number, number,
date, moment, or true and false; else the column stays text. Whole numbers are numbers
and dates are moments, so a mixed column gets the wider of both. Numbers with leading
zeros are codes and stay text, or their zeros would be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col, is_present, kind, parse_number, parse_timestamp, strip, type_of

WHOLE, CODE, FLAG = r"^[+-]?(0|[1-9][0-9]{0,17})$", r"^[+-]?0[0-9]", r"(?i)^(true|false)$"


def _readings(text: Column) -> dict[str, tuple[Column, Column]]:
    """By type, narrowest first: whether a stripped text reads as it, and its value."""
    number, moment = parse_number(text), parse_timestamp(text)
    is_moment = moment.isNotNull() & ~text.rlike(CODE)
    return {
        "boolean": (text.rlike(FLAG), F.lower(text).try_cast("boolean")),
        "bigint": (text.rlike(WHOLE), text.try_cast("bigint")),
        "double": (number.isNotNull() & ~text.rlike(CODE), number),
        "date": (is_moment & (moment == moment.cast("date").cast("timestamp_ntz")), moment.cast("date")),
        "timestamp_ntz": (is_moment, moment),
    }


def infer_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The table with text columns turned into the type that all their filled cells read as. One pass over all rows, at once.

    Blank cells become null where a type is chosen. Columns that are no text, have no
    filled cell, or a name with a leading _, stay as they are.
    """
    names = [n for n in (columns or df.columns) if kind(type_of(df, n)) == "text" and not n.startswith("_")]
    if not names:
        return df
    counts = []
    for i, name in enumerate(names):
        filled = is_present(df, name)
        counts.append(F.count_if(filled).alias(f"filled{i}"))
        counts += [F.count_if(filled & F.coalesce(test, F.lit(False))).alias(f"{t}{i}") for t, (test, _) in _readings(strip(col(name))).items()]
    found = df.agg(*counts).first()
    typed = {}
    for i, name in enumerate(names):
        readings = _readings(strip(col(name)))
        fitting = [t for t in readings if found[f"filled{i}"] and found[f"{t}{i}"] == found[f"filled{i}"]]
        if fitting:
            typed[name] = readings[fitting[0]][1]
    return df.withColumns(typed) if typed else df
