"""Data-quality marks: missing required values and spreadsheet error values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.columns import col, columns_of, is_present, kind, require_columns, strip, type_of

# Error literals of spreadsheet cells.
ERROR_LITERALS = ["#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#SPILL!", "#CALC!"]


def mark_missing_required(
    df: DataFrame, columns: list[str] | str, result_column: str = "is_missing_required",
    detail_column: str = "missing_columns",
) -> DataFrame:
    """Flag rows with a blank required cell and list the columns."""
    blanks = [F.when(~is_present(df, n), F.lit(n)) for n in columns_of(columns)]
    detail = F.concat_ws(", ", *blanks)
    return df.withColumns({detail_column: detail, result_column: detail != ""})


def mark_error_values(
    df: DataFrame, columns: list[str] | str | None = None, result_column: str = "has_error",
    detail_column: str = "error_detail",
) -> DataFrame:
    """Flag rows with an error literal in a text cell and list `column=value`."""
    names = columns_of(columns) or df.columns
    require_columns(df, names)
    texts = [n for n in names if kind(type_of(df, n)) == "text"]
    found = [
        F.when(strip(col(n)).isin(ERROR_LITERALS), F.concat(F.lit(f"{n}="), col(n))) for n in texts
    ]
    detail = F.concat_ws("; ", *found) if found else F.lit("")
    return df.withColumns({detail_column: detail, result_column: detail != ""})
