"""Filters, sorting, top N and latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query

_STATUS = "(SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status FROM orders)"


def _status(t):
    return t("orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"))


_CONDITIONS = {
    "equal": ("status", "==", "F", "status = 'F'"),
    "not_equal": ("status", "!=", "F", "status IS DISTINCT FROM 'F'"),
    "greater": ("o_totalprice", ">", 250000, "o_totalprice > 250000"),
    "at_least": ("o_totalprice", ">=", 250000.5, "o_totalprice >= 250000.5"),
    "less": ("o_totalprice", "<", 20000, "o_totalprice < 20000"),
    "at_most": ("o_totalprice", "<=", 90000, "o_totalprice <= 90000"),
    "between": ("o_totalprice", "between", [1000, 50000], "o_totalprice BETWEEN 1000 AND 50000"),
    "in": ("status", "in", ["O", "X"], "status IN ('O', 'X')"),
    "not_in": ("status", "not_in", ["O", "X"], "coalesce(status NOT IN ('O', 'X'), TRUE)"),
    "is_null": ("status", "is_null", None, "status IS NULL"),
    "not_null": ("status", "not_null", None, "status IS NOT NULL"),
    "number_contains": ("o_totalprice", "contains", "77.", "contains(CAST(o_totalprice AS VARCHAR), '77.')"),
}


def _condition(name, column, operator, value, test):
    @query(f"SELECT * FROM {_STATUS} WHERE {test}", name=f"filter_rows_{name}")
    def run(t):
        return rm.filter_rows(_status(t), column, operator, value)


for _name, _spec in _CONDITIONS.items():
    _condition(_name, *_spec)


@query("SELECT doc_id, lang FROM documents WHERE contains(text, 'license')")
def filter_rows_contains(t):
    return rm.filter_rows(t("documents"), "text", "contains", "license").select("doc_id", "lang")


@query("SELECT * FROM part WHERE starts_with(p_name, 'red')")
def filter_rows_startswith(t):
    return rm.filter_rows(t("part"), "p_name", "startswith", "red")


@query("SELECT * FROM part WHERE ends_with(p_name, 'ing')")
def filter_rows_endswith(t):
    return rm.filter_rows(t("part"), "p_name", "endswith", "ing")


@query("SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
def filter_rows_by_date(t):
    return rm.filter_rows(t("orders"), "o_orderdate", "between", ["1996-01-01", "1996-12-31"])


@query("SELECT * FROM lineitem WHERE l_returnflag = 'R' OR l_discount > 0.08 OR l_quantity <= 2")
def filter_by_conditions(t):
    return rm.filter_by_conditions(t("lineitem"), [
        {"column": "l_returnflag", "operator": "==", "value": "R"}, {"column": "l_discount", "operator": ">", "value": 0.08},
        {"column": "l_quantity", "operator": "<=", "value": 2},
    ], logic="or")


_GROUPS = [
    {"conditions": [
        {"column": "o_orderstatus", "operator": "==", "value": "F"}, {"column": "o_totalprice", "operator": ">", "value": 400000},
    ], "logic": "and"},
    {"conditions": [
        {"column": "o_orderpriority", "operator": "startswith", "value": "1"}, {"column": "o_orderdate", "operator": ">=", "value": "1998-01-01"},
    ], "logic": "and"},
]
_GROUP_TEST = """((o_orderstatus = 'F' AND o_totalprice > 400000)
  OR (starts_with(o_orderpriority, '1') AND o_orderdate >= TIMESTAMP '1998-01-01'))"""


@query(f"SELECT * FROM orders WHERE {_GROUP_TEST}")
def filter_by_condition_groups(t):
    return rm.filter_by_conditions(t("orders"), condition_groups=_GROUPS)


@query(f"SELECT o_orderkey, CASE WHEN {_GROUP_TEST} THEN 'check' ELSE 'fine' END AS verdict FROM orders")
def add_conditional_column(t):
    df = rm.add_conditional_column(t("orders"), "verdict", condition_groups=_GROUPS, true_value="check", false_value="fine")
    return rm.select_columns(df, ["o_orderkey", "verdict"])


_PERIODS = {
    "today": (None, "o_orderdate >= DATE '1998-06-15' AND o_orderdate < DATE '1998-06-16'"),
    "last_n_days": (30, "o_orderdate >= DATE '1998-05-17' AND o_orderdate < DATE '1998-06-16'"),
    "older_than_n_days": (365, "o_orderdate < DATE '1997-06-15'"),
    "this_month": (None, "o_orderdate >= DATE '1998-06-01' AND o_orderdate < DATE '1998-07-01'"),
    "last_month": (None, "o_orderdate >= DATE '1998-05-01' AND o_orderdate < DATE '1998-06-01'"),
    "this_year": (None, "o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1999-01-01'"),
    "last_year": (None, "o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01'"),
}


def _period(period, days, test):
    @query(f"SELECT * FROM orders WHERE {test}", name=f"filter_relative_dates_{period}")
    def run(t):
        return rm.filter_relative_dates(t("orders"), "o_orderdate", period, days=days, today="1998-06-15")


for _name, _spec in _PERIODS.items():
    _period(_name, *_spec)


@query("SELECT * FROM lineitem WHERE l_shipdate >= DATE '1996-07-01' AND l_shipdate < DATE '1997-01-01'")
def filter_calendar_half_year(t):
    return rm.filter_calendar_period(t("lineitem"), "l_shipdate", 1996, half=2)


@query("SELECT * FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-04-01'")
def filter_calendar_quarter(t):
    return rm.filter_calendar_period(t("events"), "ts", 2024, quarter=1)


@query("SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC")
def sort_rows(t):
    return rm.sort_rows(t("orders"), ["o_orderpriority", "o_totalprice"], [True, False])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def select_top_n(t):
    return rm.select_top_n(t("orders"), "o_totalprice", 25, order_columns="o_orderkey")


@query("SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity LIMIT 120000")
def select_top_n_of_a_long_list(t):
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]
    return rm.select_top_n(t("lineitem"), "l_extendedprice", 120_000, order_columns=ties, rows_per_task=20_000)


@query("SELECT * FROM events ORDER BY value, event_id LIMIT 100")
def select_bottom_n(t):
    return rm.select_top_n(t("events"), "value", 100, largest=False, order_columns="event_id")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_latest_per_group(t):
    return rm.keep_latest_per_group(t("orders"), "o_custkey", "o_orderdate", order_columns="o_orderkey")


@query("SELECT * FROM orders QUALIFY rank() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC) = 1")
def keep_latest_per_group_with_ties(t):
    return rm.keep_latest_per_group(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_orderdate", keep_ties=True)
