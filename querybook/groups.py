"""Aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query

_MONEY = "decimal(18,2)"


def _cents(t, table, column):
    """A table whose money column is exact, so that sums do not depend on their order."""
    return t(table).withColumn(column, F.col(column).cast(_MONEY))


def _as_double(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query("""SELECT nullif(l_returnflag, 'R') AS flag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
  FROM lineitem GROUP BY 1, 2""")
def group_sum(t):
    df = _cents(t, "lineitem", "l_extendedprice").withColumn("flag", F.nullif("l_returnflag", F.lit("R")))
    return _as_double(rm.group_sum(df, ["flag", "l_linestatus"], "l_extendedprice", "total"), "total")


@query("""SELECT o_orderpriority, CAST(coalesce(sum(CASE WHEN o_orderpriority <> '5-LOW' THEN o_custkey END), 0) AS BIGINT) AS total
  FROM orders GROUP BY 1""")
def group_sum_of_nothing(t):
    df = t("orders").withColumn("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey")))
    return rm.group_sum(df, "o_orderpriority", "o_custkey", "total")


@query("SELECT user_id, round(avg(value), 6) AS average FROM events GROUP BY user_id")
def group_average(t):
    df = rm.group_average(t("events"), "user_id", "value")
    return df.withColumn("average", F.round("average", 6))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def group_count(t):
    return rm.group_count(t("documents"), ["lang", "source"], "n")


_AGGREGATES = [
    ("l_quantity", "sum", "quantity"), ("l_discount", "mean", "discount"), ("l_tax", "count", "taxed"), ("l_orderkey", "size", "lines"),
    ("l_partkey", "nunique", "parts"), ("l_shipdate", "min", "first_shipped"), ("l_shipdate", "max", "last_shipped"),
    ("l_extendedprice", "median", "middle_price"),
]


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_discount), 8) AS discount, count(l_tax) AS taxed,
  count(*) AS lines, count(DISTINCT l_partkey) AS parts, min(l_shipdate) AS first_shipped, max(l_shipdate) AS last_shipped,
  median(l_extendedprice) AS middle_price FROM lineitem GROUP BY 1, 2""")
def group_aggregate(t):
    wanted = [{"column": c, "function": f, "result_column": r} for c, f, r in _AGGREGATES]
    df = rm.group_aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], wanted)
    return df.withColumn("discount", F.round("discount", 8))


@query("SELECT l_returnflag, count(*) AS lines, median(l_extendedprice) AS middle_price, median(l_quantity) AS middle_quantity FROM lineitem GROUP BY 1")
def group_aggregate_median_of_hot_groups(t):
    wanted = [
        {"column": "l_orderkey", "function": "size", "result_column": "lines"},
        {"column": "l_extendedprice", "function": "median", "result_column": "middle_price"},
        {"column": "l_quantity", "function": "median", "result_column": "middle_quantity"},
    ]
    return rm.group_aggregate(t("lineitem"), "l_returnflag", wanted)


def _cases(column, values, cell, names=None):
    return ", ".join(f"{cell.format(test=f'{column} = {v!r}')} AS \"{n}\"" for v, n in zip(values, names or values))


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("SELECT o_orderstatus, " + _cases(
    "o_orderpriority", _PRIORITIES, "CAST(coalesce(sum(CASE WHEN {test} THEN CAST(o_totalprice AS DECIMAL(18, 2)) END), 0) AS DOUBLE)",
) + " FROM orders GROUP BY 1")
def pivot_table_sum(t):
    df = rm.pivot_table(_cents(t, "orders", "o_totalprice"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return _as_double(df, *df.columns[1:])


@query("SELECT c_nationkey, " + _cases("c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
       "coalesce(max(CASE WHEN {test} AND c_acctbal > 5000 THEN c_acctbal END), -1)") + " FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def pivot_table_max(t):
    df = t("customer").withColumn("c_acctbal", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")))
    return rm.pivot_table(df, ["c_nationkey"], "c_mktsegment", "c_acctbal", "max", fill_value=-1)


@query("SELECT l_returnflag, " + _cases("l_linestatus", ["F", "O"], "coalesce(count(CASE WHEN {test} THEN l_tax END), 0)", ["l_tax F", "l_tax O"])
       + ", " + _cases("l_linestatus", ["F", "O"], "coalesce(count(CASE WHEN {test} THEN l_discount END), 0)", ["l_discount F", "l_discount O"])
       + " FROM lineitem GROUP BY 1")
def pivot_table_of_two_values(t):
    return rm.pivot_table(t("lineitem"), "l_returnflag", "l_linestatus", ["l_tax", "l_discount"], "count")


@query("SELECT event_type, " + _cases("day", ["2024-01-01", "2024-01-02", "2024-01-03"], "round(avg(CASE WHEN {test} THEN value END), 6)")
       + " FROM (SELECT event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY 1")
def pivot_table_mean_by_day(t):
    df = rm.convert_column_type(t("events"), "ts", "date")
    listed = ["2024-01-01", "2024-01-02", "2024-01-03"]
    df = rm.pivot_table(df, "event_type", "ts", "value", "mean", fill_value=None, pivot_values=listed)
    return df.select("event_type", *[F.round(F.col(f"`{d}`"), 6).alias(d) for d in listed])


_DAYS = [f"2024-01-{d:02}" for d in range(1, 31)]


@query("SELECT event_type, " + _cases("day", _DAYS, "round(avg(CASE WHEN {test} THEN value END), 6)")
       + " FROM (SELECT event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY 1")
def pivot_table_mean_by_every_day(t):
    df = rm.convert_column_type(t("events"), "ts", "date")
    df = rm.pivot_table(df, "event_type", "ts", "value", "mean", fill_value=None)
    return df.select("event_type", *[F.round(F.col(f"`{d}`"), 6).alias(d) for d in df.columns[1:]])
