"""Numbers and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query


def _formatted_balance(t):
    """Account balances as formatted text, one style per market segment."""
    size = F.format_number(F.abs("c_acctbal"), 2)
    text = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("("), size, F.lit(")")))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.concat(F.lit(" USD "), size))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(size, F.lit("원")))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(size, F.lit(" %")))
        .otherwise(F.concat(F.lit("₩"), size))
    )
    return t("customer").select("c_custkey", text.alias("balance"))


@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN -abs(c_acctbal)
  WHEN 'HOUSEHOLD' THEN abs(c_acctbal) / 100 ELSE abs(c_acctbal) END AS balance FROM customer""")
def clean_numeric_values(t):
    return rm.clean_numeric_values(_formatted_balance(t), "balance", percent_as_fraction=True)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders""")
def clean_numeric_values_coerced(t):
    text = F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.format_number("o_totalprice", 2))
    return rm.clean_numeric_values(t("orders").select("o_orderkey", text.alias("price")), "price", errors="coerce")


@query("""SELECT l_orderkey, sign(l_extendedprice * l_discount * 100.0) * floor(abs(l_extendedprice * l_discount * 100.0) + 0.5) / 100.0 AS saved
  FROM lineitem""")
def round_numbers(t):
    df = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * F.col("l_discount")).alias("saved"))
    return rm.round_numbers(df, "saved", 2)


@query("""SELECT o_orderkey, floor(o_totalprice * 1e-3) / 1e-3 AS low, ceil(o_totalprice * 10.0) / 10.0 AS high FROM orders""")
def round_numbers_down_and_up(t):
    df = t("orders").select("o_orderkey", F.col("o_totalprice").alias("low"), F.col("o_totalprice").alias("high"))
    return rm.round_numbers(rm.round_numbers(df, "low", -3, "floor"), "high", 1, "ceil")


_CALCULATIONS = {
    "add": "l_quantity + l_tax", "subtract": "l_quantity - l_tax", "multiply": "l_quantity * l_tax",
    "divide": "CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END",
    "percent_of": "CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END * 100",
    "absolute_difference": "abs(l_quantity - l_tax)",
}


def _calculation(operator, expression):
    @query(f"SELECT l_orderkey, l_linenumber, {expression} AS result FROM lineitem", name=f"calculate_column_{operator}")
    def run(t):
        df = rm.calculate_column(t("lineitem"), "result", operator, "l_quantity", right_column="l_tax")
        return df.select("l_orderkey", "l_linenumber", "result")


for _operator, _expression in _CALCULATIONS.items():
    _calculation(_operator, _expression)


@query("SELECT p_partkey, CAST(p_size + 10 AS BIGINT) AS larger FROM part")
def calculate_column_with_a_constant(t):
    df = rm.calculate_column(t("part"), "larger", "add", "p_size", value=10)
    return rm.select_columns(df, ["p_partkey", "larger"])


@query("""SELECT o_orderkey, o_totalprice - lines AS difference, coalesce(abs(o_totalprice - lines) <= 100000, FALSE) AS matches
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS lines
  FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def compare_columns(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    joined = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    df = rm.compare_columns(joined, "o_totalprice", "lines", tolerance=100000)
    return rm.select_columns(df, ["o_orderkey", "difference", "matches"])


@query("""SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(quarter(ts) AS INTEGER) AS ts_quarter,
  CAST(month(ts) AS INTEGER) AS ts_month, CAST(week(ts) AS INTEGER) AS ts_week, CAST(day(ts) AS INTEGER) AS ts_day,
  CAST(isodow(ts) AS INTEGER) AS ts_weekday FROM events""")
def add_date_parts(t):
    parts = ["year", "quarter", "month", "week", "day", "weekday"]
    return rm.add_date_parts(t("events").select("event_id", "ts"), "ts", parts).drop("ts")


_SHIPPED = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def _shipped(t):
    orders = t("orders").select("o_orderkey", "o_orderdate")
    joined = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query(f"""SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate,
  CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE) AS days FROM {_SHIPPED}""")
def calculate_date_difference(t):
    return rm.calculate_date_difference(_shipped(t), "o_orderdate", "l_shipdate", "days")


@query(f"""SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate,
  abs(CAST(date_diff('day', o_orderdate, l_shipdate) AS DOUBLE)) / 7 AS weeks FROM {_SHIPPED}""")
def calculate_date_difference_in_weeks(t):
    return rm.calculate_date_difference(_shipped(t), "o_orderdate", "l_shipdate", "weeks", unit="weeks", absolute=True)


_MONTHS = """((year({b}) - year({a})) * 12 + month({b}) - month({a}) - CASE WHEN day({b}) < day({a}) THEN 1 ELSE 0 END)"""


@query(f"""SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate, CAST(CASE WHEN l_shipdate >= o_orderdate
  THEN {_MONTHS.format(a='o_orderdate', b='l_shipdate')} ELSE -{_MONTHS.format(a='l_shipdate', b='o_orderdate')} END AS DOUBLE) AS months
  FROM {_SHIPPED}""")
def calculate_date_difference_in_months(t):
    return rm.calculate_date_difference(_shipped(t), "o_orderdate", "l_shipdate", "months", unit="months")


@query("""SELECT o_orderkey, CAST(date_diff('day', o_orderdate, TIMESTAMP '1998-06-15') AS DOUBLE) AS age FROM orders""")
def calculate_date_difference_to_today(t):
    df = rm.calculate_date_difference(t("orders"), "o_orderdate", result_column="age", end_mode="today", today="1998-06-15")
    return rm.select_columns(df, ["o_orderkey", "age"])
