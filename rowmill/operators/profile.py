"""A profile of every column, as a table with one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import (
    col, is_missing, kind, parse_number, parse_timestamp, text_of, to_double, to_text, type_of,
)
from rowmill.operators.numeric import rounded
from rowmill.plans.hot_ranges import ROWS_PER_TASK, needs_split
from rowmill.plans.lineage import materialize
from rowmill.plans.selection import medians

SAMPLES, TOP_VALUES = 3, 3


def _value_counts(df: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """(column, value, count, first place) of every distinct value, counted on the map side."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("column_id"), to_text(df, n).alias("value")) for i, n in enumerate(names)
    ])).alias("cell")
    # A single order column keeps the minimum in a hash aggregate; a struct needs a sorted one.
    place = (col(order[0]) if len(order) == 1 else F.struct(*[col(o) for o in order])) if order else None
    base = df.select(cells, *([place.alias("place")] if order else []))
    base = base.select("cell.column_id", "cell.value", *(["place"] if order else [])).filter(F.col("value").isNotNull())
    counts = [F.count(F.lit(1)).alias("n")]
    if order:
        counts.append(F.min("place").alias("place"))
    counted = base.groupBy("column_id", "value").agg(*counts)
    return counted if order else counted.withColumn("place", F.col("value"))


def _first_values(counted: DataFrame, order: list, limit: int, name: str, cell) -> DataFrame:
    """The first `limit` values of each column; Spark keeps no more than that per task."""
    window = Window.partitionBy("column_id").orderBy(*order)
    kept = counted.withColumn("_i", F.row_number().over(window)).filter(F.col("_i") <= limit)
    items = F.sort_array(F.collect_list(F.struct("_i", cell.alias("item"))))
    return kept.groupBy("column_id").agg(F.transform(items, lambda x: x["item"]).alias(name))


def _as_text(df: DataFrame, name: str) -> Column:
    data_type = type_of(df, name)
    if isinstance(data_type, T.BinaryType):
        return F.hex(col(name))
    nested = isinstance(data_type, (T.ArrayType, T.MapType, T.StructType))
    return F.to_json(col(name)) if nested else col(name).cast("string")


def profile_table(
    df: DataFrame, order_columns: list[str] | str | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Type, counts, samples and statistics of each column.

    Samples are the first distinct values in row order when `order_columns` are
    given, else the smallest ones. Top values are listed for columns whose
    values repeat (distinct <= max(20, rows / 2)).
    """
    order = [order_columns] if isinstance(order_columns, str) else list(order_columns or [])
    names = df.columns
    types = {n: type_of(df, n).simpleString() for n in names}
    # Nested values are profiled by their JSON text, binary ones by their hexadecimal digits.
    df = df.withColumns({n: _as_text(df, n) for n in names if kind(type_of(df, n)) == "other"})
    what = {n: kind(type_of(df, n)) for n in names}
    numeric = [n for n in names if what[n] == "number"]
    # One pass for everything that needs no distinct values.
    scalars = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        missing = is_missing(df, name)
        scalars.append(F.count_if(missing).alias(f"missing{i}"))
        if what[name] == "number":
            v = to_double(df, name)
            for stat, value in {
                "min": F.min(v), "max": F.max(v), "sum": F.sum(v), "mean": F.avg(v),
                "zero": F.count_if(v == 0), "negative": F.count_if(v < 0),
            }.items():
                scalars.append(value.alias(f"{stat}{i}"))
        elif what[name] == "datetime":
            scalars += [F.min(col(name)).alias(f"first{i}"), F.max(col(name)).alias(f"last{i}")]
        elif what[name] == "text":
            number = parse_number(col(name)).isNotNull()
            date = parse_timestamp(col(name)).isNotNull() & ~number
            scalars += [
                F.avg(F.length(col(name))).alias(f"length{i}"), F.count_if(number).alias(f"number{i}"),
                F.count_if(date).alias(f"date{i}"),
            ]
    one = df.agg(*scalars)
    null_double, null_long, null_text = (F.lit(None).cast(t) for t in ("double", "long", "string"))

    def fact(name: str, stat: str, otherwise):
        i = names.index(name)
        return F.col(f"{stat}{i}") if f"{stat}{i}" in one.columns else otherwise

    rows = [
        F.struct(
            F.lit(i).alias("column_id"), F.lit(n).alias("column"),
            F.lit(types[n]).alias("type"), F.col("rows"),
            F.col(f"missing{i}").alias("missing_count"),
            *[fact(n, s, null_double).alias(s) for s in ("min", "max", "sum", "mean")],
            fact(n, "zero", null_long).alias("zero_count"), fact(n, "negative", null_long).alias("negative_count"),
            *[
                (text_of(F.col(f"{s}{i}"), type_of(df, n)) if what[n] == "datetime" else null_text).alias(a)
                for s, a in (("first", "min_date"), ("last", "max_date"))
            ],
            fact(n, "length", null_double).alias("length"),
            fact(n, "number", null_long).alias("numbers"), fact(n, "date", null_long).alias("dates"),
        )
        for i, n in enumerate(names)
    ]
    facts = one.select(F.explode(F.array(*rows)).alias("f")).select("f.*")
    large = needs_split(df, rows_per_task)
    counted = _value_counts(df, names, order)
    if large:
        counted = materialize(counted)  # read three times below
    per_column = counted.groupBy("column_id").agg(F.count(F.lit(1)).alias("unique_count"))
    samples = _first_values(counted, [F.col("place"), F.col("value")], SAMPLES, "sample_values", F.col("value"))
    top = _first_values(
        counted, [F.desc("n"), F.col("place"), F.col("value")], TOP_VALUES, "top_values",
        F.struct(F.col("value"), F.col("n").alias("count")),
    )
    for part in (per_column, samples, top, _medians(df, names, numeric)):
        facts = facts.join(F.broadcast(part), "column_id", "left")  # one row per column
    filled = F.col("rows") - F.col("missing_count")
    unique = F.coalesce(F.col("unique_count"), F.lit(0))

    def ratio(part):
        return rounded(F.try_divide(part.cast("double"), filled.cast("double")), 4)

    texts = [n for n in names if what[n] in ("text", "boolean")]
    repeated = F.col("column").isin(texts) & (unique <= F.greatest(F.lit(20), F.floor(filled / 2)))
    is_text = F.col("numbers").isNotNull() & (filled > 0)
    return facts.select(
        "column", "type", F.col("rows").alias("row_count"), "missing_count", unique.alias("unique_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        "min", "max", "sum", "mean", "median", "zero_count", "negative_count", "min_date", "max_date",
        F.when(is_text, ratio(unique)).alias("unique_ratio"),
        rounded(F.col("length"), 2).alias("average_length"),
        F.when(is_text, ratio(F.col("numbers"))).alias("numeric_parse_ratio"),
        F.when(is_text, ratio(F.col("dates"))).alias("datetime_parse_ratio"),
        F.when(repeated, F.col("top_values")).alias("top_values"),
    )


def _medians(df: DataFrame, names: list[str], numeric: list[str]) -> DataFrame:
    if not numeric:
        return df.sparkSession.createDataFrame([], "column_id int, median double")
    one = medians(df, None, {f"m{names.index(n)}": n for n in numeric})
    rows = [F.struct(F.lit(names.index(n)).alias("column_id"), F.col(f"m{names.index(n)}").alias("median")) for n in numeric]
    return one.select(F.explode(F.array(*rows)).alias("m")).select("m.*")
