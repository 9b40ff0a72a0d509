"""Rows added to a table: subtotals, totals and conditional summaries.

Added rows are told apart by `_row_kind` (detail, subtotal, grand_total,
summary). A table has no order until it is sorted; `sort_with_totals` puts every
added row where it belongs. Totals cover detail rows only, so several of them
do not add each other up.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import (
    col, columns_of, is_missing, kind, or_null, require_columns, text_of, to_number, to_text, type_of,
)
from rowmill.functions.predicates import all_of
from rowmill.plans.hot_ranges import Order, row_hash, sort_columns
from rowmill.plans.lineage import written

KIND, GROUP_ORDER, SUMMARY_ORDER = "_row_kind", "_group_order", "_summary_order"
DETAIL, SUBTOTAL, GRAND_TOTAL, SUMMARY = "detail", "subtotal", "grand_total", "summary"
TOTAL_AGGREGATES = ("sum", "average", "count", "min", "max")
SUMMARY_AGGREGATES = ("sum", "count", "average")
SUMMARY_OPERATORS = (
    "==", "!=", ">", ">=", "<", "<=", "contains", "startswith", "endswith", "is_null", "not_null",
)


def _sum(df: DataFrame, column: str) -> Column:
    """Sum of the numeric view of a column, in the column's kind (number or text)."""
    number = to_number(df, column)
    if kind(type_of(df, column)) == "number":
        return F.coalesce(F.sum(number), F.lit(0).cast(type_of(df, column)))
    return text_of(F.coalesce(F.sum(number.cast("double")), F.lit(0.0)), T.DoubleType())


def add_subtotals(
    df: DataFrame, group_columns: list[str] | str, value_columns: list[str] | str, label: str = "Subtotal",
    include_grand_total: bool = True, grand_total_label: str = "Grand total",
    order_columns: list[str] | str | None = None,
) -> DataFrame:
    """Detail rows, one subtotal row per group and optionally a grand total.

    `_group_order` is the group's smallest row order when `order_columns` are
    given (groups in order of first appearance), else the group key itself. Subtotals
    and grand total come from one pass; with `order_columns` that pass runs at once,
    as the detail rows read it too.
    """
    groups, values = columns_of(group_columns), columns_of(value_columns)
    require_columns(df, [*groups, *values, *columns_of(order_columns)])
    if not groups or not values:
        raise ValueError("name at least one group column and one value column")
    order = columns_of(order_columns)
    keys, named = [col(g) for g in groups], [f"_group{i}" for i in range(len(groups))]
    sums = [_sum(df, v).alias(f"_sum{i}") for i, v in enumerate(values)]
    rank = _as_one([or_null(df, o) for o in order] if order else keys)
    place = F.min(rank) if order else _as_one([F.col(n).alias(g) for n, g in zip(named, groups)])
    # named first, so that sums read a group column's values and not the key that a set leaves out
    rows, sets = df.withColumns(dict(zip(named, keys)) | {"_real": F.lit(1)}), [[F.col(n) for n in named]]
    if include_grand_total:
        # an empty table has a grand total too: a row that is none gives its set a row to sum
        rows = rows.unionByName(df.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))
        sets.append([])
    totals = rows.groupingSets(sets, *[F.col(n) for n in named]).agg(*sums, place.alias(GROUP_ORDER), F.grouping_id().alias("_level"), F.count("_real").alias("_rows"))
    totals = totals.where("_level > 0 or _rows > 0")
    if order:
        totals = written(totals, "subtotals")
    per_group = totals.where("_level = 0")

    detail = df
    if order:
        match = [k.eqNullSafe(F.col(f"_group{i}")) for i, k in enumerate(keys)]
        places = per_group.select(*named, GROUP_ORDER)
        detail = df.join(places, match, "left").drop(*named)
        position = F.col(GROUP_ORDER)
    else:
        position = rank
    first_group = [to_text(df, n).alias(n) if n == groups[0] else col(n) for n in df.columns]
    result = detail.select(*first_group, F.lit(DETAIL).alias(KIND), position.alias(GROUP_ORDER))
    return result.unionByName(_labelled(df, totals, groups, values, label, grand_total_label))


def _labelled(df: DataFrame, totals: DataFrame, groups: list[str], values: list[str], label: str, grand_total_label: str) -> DataFrame:
    """The rows to add: labels in the first group column, sums in the value columns, null elsewhere."""
    grand = F.col("_level") > 0
    cells = []
    for name in df.columns:
        if name == groups[0]:
            cell = F.when(grand, F.lit(grand_total_label)).otherwise(F.lit(label))
        elif name in values:
            cell = F.col(f"_sum{values.index(name)}")
        else:
            cell = F.lit(None).cast(type_of(df, name))
        cells.append(cell.alias(name))
    return totals.select(
        *cells, F.when(grand, F.lit(GRAND_TOTAL)).otherwise(F.lit(SUBTOTAL)).alias(KIND), F.when(~grand, F.col(GROUP_ORDER)).alias(GROUP_ORDER),
    )


def _as_one(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def sort_with_totals(df: DataFrame, order_columns: list[str] | str | None = None) -> DataFrame:
    """Groups in order, each subtotal under its rows, totals and summaries at the end."""
    rank = F.when(F.col(KIND) == GRAND_TOTAL, 1).when(F.col(KIND) == SUMMARY, 2).otherwise(0)
    keys = [rank]
    if GROUP_ORDER in df.columns:
        keys.append(F.col(GROUP_ORDER).asc_nulls_last())
    keys.append((F.col(KIND) != DETAIL).asc())
    if SUMMARY_ORDER in df.columns:
        keys.append(F.col(SUMMARY_ORDER).asc_nulls_first())
    names = columns_of(order_columns)
    # detail rows of a group share one key, so a hash of the row spreads what the order columns leave together
    spread = row_hash(df, [KIND, GROUP_ORDER, SUMMARY_ORDER, *names])
    return df.orderBy(*keys, *sort_columns(df, [Order(o) for o in names]), *([spread] if spread is not None else []))


def _details(df: DataFrame) -> DataFrame:
    return df.filter(F.col(KIND) == DETAIL) if KIND in df.columns else df


def _append(df: DataFrame, labels: dict[str, str], results: dict[str, Column]) -> DataFrame:
    """`df` plus one summary row holding the results over its detail rows and the labels, null elsewhere.

    A label turns its column into text; a result gives its column the result's type. The
    results are a scalar subquery: Spark merges those of several summary rows, so that
    they take one scan together.
    """
    found = _details(df).agg(F.struct(*[c.alias(f"_result_{n}") for n, c in results.items()])).scalar()
    row = df.sparkSession.range(1).select(found.alias("found")).select("found.*")
    base = df if KIND in df.columns else df.withColumn(KIND, F.lit(DETAIL))
    if SUMMARY_ORDER not in base.columns:
        base = base.withColumn(SUMMARY_ORDER, F.lit(None).cast("int"))
    depth = base.schema[SUMMARY_ORDER].metadata.get("rows", 0) + 1
    upper, lower = [], []
    for name in base.columns:
        if name in (KIND, SUMMARY_ORDER):
            continue
        if name in results:
            result_type = row.schema[f"_result_{name}"].dataType
            value, own = F.col(f"_result_{name}"), type_of(base, name)
            if kind(own) == "text":
                upper.append(col(name))
                lower.append(text_of(value, result_type).alias(name))
            elif kind(own) == "number":
                wide = own if own == result_type else _wider(own, result_type)
                upper.append(col(name).cast(wide).alias(name))
                lower.append(value.cast(wide).alias(name))
            else:
                upper.append(to_text(base, name).alias(name))
                lower.append(text_of(value, result_type).alias(name))
        elif name in labels:
            upper.append(to_text(base, name).alias(name))
            lower.append(F.lit(labels[name]).alias(name))
        else:
            upper.append(col(name))
            lower.append(F.lit(None).cast(type_of(base, name)).alias(name))
    number = F.lit(depth).alias(SUMMARY_ORDER)
    top = base.select(*upper, KIND, col(SUMMARY_ORDER))
    bottom = row.select(*lower, F.lit(SUMMARY).alias(KIND), number)
    both = top.unionByName(bottom)
    return both.withMetadata(SUMMARY_ORDER, {"rows": depth})


def _wider(left: T.DataType, right: T.DataType) -> T.DataType:
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    if isinstance(left, T.DecimalType) and isinstance(right, T.DecimalType):
        scale = max(left.scale, right.scale)
        return T.DecimalType(min(38, max(left.precision - left.scale, right.precision - right.scale) + scale), scale)
    return T.DoubleType()


def add_total_row(
    df: DataFrame, value_columns: list[str] | str, label: str = "Total", aggregate: str = "sum",
) -> DataFrame:
    """One row below the table: sum, average, count (of filled cells), min or max.

    Text cells are no numbers here, as in a spreadsheet total; they only count.
    """
    values = columns_of(value_columns)
    require_columns(df, values)
    if not values:
        raise ValueError("name at least one value column")
    if aggregate not in TOTAL_AGGREGATES:
        raise ValueError(f"unknown total: {aggregate!r}")
    results = {}
    for name in values:
        number = or_null(df, name) if kind(type_of(df, name)) == "number" else F.lit(None).cast("double")
        if aggregate == "count":
            results[name] = F.count(F.when(~is_missing(df, name), F.lit(1)))
        elif aggregate == "sum":
            results[name] = F.coalesce(F.sum(number), F.lit(0))
        else:
            results[name] = {"average": F.avg, "min": F.min, "max": F.max}[aggregate](number)
    first = next(n for n in df.columns if not n.startswith("_"))
    return _append(df, {first: label}, results)


def _conditions(
    condition_column: str | None, operator: str | None, value: Any, conditions: list[dict[str, Any]] | None,
) -> list[dict[str, Any]]:
    if conditions is not None and (condition_column is not None or operator is not None):
        raise ValueError("give one condition or a list of conditions, not both")
    if conditions is None:
        if condition_column is None or operator is None:
            raise ValueError("a condition needs condition_column, operator and value")
        conditions = [{"column": condition_column, "operator": operator, "value": value}]
    if not conditions:
        raise ValueError("at least one condition is needed")
    unsupported = [c["operator"] for c in conditions if c["operator"] not in SUMMARY_OPERATORS]
    if unsupported:
        raise ValueError(f"operators not available in a summary row: {unsupported}")
    return conditions


def add_conditional_summary_row(
    df: DataFrame, aggregate: str, output_column: str, condition_column: str | None = None,
    operator: str | None = None, value: Any = None, conditions: list[dict[str, Any]] | None = None,
    logic: str = "and", value_column: str | None = None, label: str = "Conditional summary",
    label_column: str | None = None,
) -> DataFrame:
    """One row below the table: sum, count or average over the rows that meet all conditions."""
    tests = _conditions(condition_column, operator, value, conditions)
    if logic != "and":
        raise ValueError("summary conditions are joined by 'and'")
    if aggregate not in SUMMARY_AGGREGATES:
        raise ValueError(f"unknown summary: {aggregate!r}")
    if aggregate != "count" and not value_column:
        raise ValueError(f"{aggregate} needs a value_column")
    require_columns(df, [output_column, *([value_column] if value_column else []), *([label_column] if label_column else [])])
    matching = all_of(df, tests)
    if aggregate == "count":
        result = F.count_if(matching)
    else:
        number = or_null(df, value_column) if kind(type_of(df, value_column)) == "number" else F.lit(None).cast("double")
        picked = F.when(matching, number)
        result = F.coalesce(F.sum(picked), F.lit(0)) if aggregate == "sum" else F.avg(picked)
    others = [n for n in df.columns if n != output_column and not n.startswith("_")]
    place = label_column or (others[0] if others else None)
    return _append(df, {place: label} if place else {}, {output_column: result})
