"""Writing results, and the audit record of a run."""

from __future__ import annotations

import datetime as dt
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from rowmill.functions.columns import kind, to_text, type_of


def _place(path: str) -> str:
    """A path in comparable form; local ones with links resolved."""
    text = str(path)
    if text.startswith("file:"):
        text = "/" + text.removeprefix("file:").lstrip("/")
    return text.rstrip("/") if "://" in text else os.path.realpath(text)


def _overlap(a: str, b: str) -> bool:
    return a == b or a.startswith(b + "/") or b.startswith(a + "/")


def result_columns(df: DataFrame, format: str = "parquet") -> DataFrame:
    """The table as it is saved: no internal columns, and dates without a zero time in text formats."""
    df = df.drop(*[n for n in df.columns if n.startswith("_")])
    if format not in ("csv", "json"):
        return df
    dates = [n for n in df.columns if kind(type_of(df, n)) == "datetime"]
    return df.withColumns({n: to_text(df, n) for n in dates}) if dates else df


def write_result(
    df: DataFrame, path: str, format: str = "parquet", source_paths: list[str] | str | None = None, **options: Any,
) -> None:
    """Save a result as new files; existing data and the sources are never overwritten."""
    sources = [source_paths] if isinstance(source_paths, str) else list(source_paths or [])
    for source in sources:
        if _overlap(_place(path), _place(source)):
            raise ValueError(f"the result would overwrite its source {source}")
    if format == "csv":
        options = {"header": True, **options}
    result_columns(df, format).write.mode("errorifexists").format(format).options(**options).save(path)


def append_run_log(
    spark: SparkSession, path: str, status: str, steps: list[dict[str, Any]], source: str = "",
    preview: list[dict[str, Any]] | None = None, error: str | None = None,
) -> None:
    """Append one JSON record about a run."""

    def as_json(value: Any) -> str | None:
        return None if value is None else json.dumps(value, ensure_ascii=False, default=str)

    now = dt.datetime.now().astimezone().isoformat(timespec="seconds")
    row = (now, status, source, as_json(steps), as_json(preview), error)
    schema = "created_at string, status string, source string, steps string, preview string, error string"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").json(path)
