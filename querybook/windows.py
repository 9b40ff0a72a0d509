"""Ranks, running totals, changes and duplicate marks; plain, over the table, and with hot groups cut into ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query

# Small enough that the order statuses (a third of the orders each) are cut into ranges at every scale.
CUT = 1000

_RANKS = {
    "average": "rank() OVER ({w}) + (count(*) OVER ({same}) - 1) / 2.0", "min": "rank() OVER ({w})",
    "max": "rank() OVER ({w}) + count(*) OVER ({same}) - 1", "dense": "dense_rank() OVER ({w})",
}
_GROUPINGS = {
    "per_customer": ("o_custkey", "o_orderdate", {}), "over_all": (None, "o_orderdate", {}),
    "cut": ("o_orderstatus", "o_orderdate", {"rows_per_task": CUT}), "over_all_cut": (None, "o_orderdate", {"rows_per_task": CUT}),
}


def _rank(method, grouping):
    group, column, options = _GROUPINGS[grouping]
    part = f"PARTITION BY {group}" if group else ""
    same = f"PARTITION BY {group}, {column}" if group else f"PARTITION BY {column}"
    expression = _RANKS[method].format(w=f"{part} ORDER BY {column} DESC", same=same)

    @query(f"SELECT o_orderkey, CAST({expression} AS DOUBLE) AS rank FROM orders", name=f"rank_rows_{method}_{grouping}")
    def run(t):
        df = rm.rank_rows(t("orders"), column, method=method, group_columns=group, **options)
        return df.select("o_orderkey", "rank")


for _method in _RANKS:
    for _grouping in _GROUPINGS:
        _rank(_method, _grouping)


def _first(grouping):
    group, column, options = _GROUPINGS[grouping]
    part = f"PARTITION BY {group}" if group else ""
    value = "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END"

    @query(f"""SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(row_number() OVER
      ({part} ORDER BY {value} NULLS LAST, o_orderkey) AS DOUBLE) END AS rank FROM orders""", name=f"rank_rows_first_{grouping}")
    def run(t):
        dated = t("orders").withColumn(column, F.when(F.col("o_orderpriority") != "5-LOW", F.col(column)))
        df = rm.rank_rows(dated, column, ascending=True, method="first", group_columns=group, order_columns="o_orderkey", **options)
        return df.select("o_orderkey", "rank")


for _grouping in _GROUPINGS:
    _first(_grouping)


def _running(grouping):
    group, _, options = _GROUPINGS[grouping]
    part = f"PARTITION BY {group}" if group else ""

    @query(f"""SELECT o_orderkey, CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18, 2)) END) OVER
      ({part} ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total FROM orders""",
           name=f"cumulative_sum_{grouping}")
    def run(t):
        price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("decimal(18,2)"))
        df = rm.cumulative_sum(
            t("orders").withColumn("o_totalprice", price), "o_totalprice", group_columns=group,
            order_columns=["o_orderdate", "o_orderkey"], **options,
        )
        return df.select("o_orderkey", F.col("running_total").cast("double").alias("running_total"))


def _change(grouping, periods):
    group, _, options = _GROUPINGS[grouping]
    part = f"PARTITION BY {group}" if group else ""
    w = f"{part} ORDER BY o_orderdate, o_orderkey"

    @query(f"""SELECT o_orderkey, (price / lag(price, {periods}) OVER ({w}) - 1) * 100 AS pct_change FROM (
      SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, last_value(CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END IGNORE NULLS)
      OVER ({w} ROWS UNBOUNDED PRECEDING) AS price FROM orders)""", name=f"percent_change_{grouping}_{periods}")
    def run(t):
        price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
        df = rm.percent_change(
            t("orders").withColumn("o_totalprice", price), "o_totalprice", group_columns=group,
            order_columns=["o_orderdate", "o_orderkey"], periods=periods, **options,
        )
        return df.select("o_orderkey", "pct_change")


for _grouping in _GROUPINGS:
    _running(_grouping)
    _change(_grouping, 1)
_change("per_customer", 2)
_change("cut", 3)

_KEPT = {
    "every_copy": (False, "count(*) OVER (PARTITION BY {k}) > 1"),
    "after_first": ("first", "row_number() OVER (PARTITION BY {k} ORDER BY o_orderkey) > 1"),
    "before_last": ("last", "row_number() OVER (PARTITION BY {k} ORDER BY o_orderkey DESC) > 1"),
}


def _duplicates(name, keys, options):
    keep, test = _KEPT[name]
    suffix = "_cut" if options else ""

    @query(f"SELECT o_orderkey, {test.format(k=', '.join(keys))} AS is_duplicate FROM orders", name=f"mark_duplicates_{name}{suffix}")
    def run(t):
        df = rm.mark_duplicates(t("orders"), keys, keep=keep, order_columns="o_orderkey", **options)
        return df.select("o_orderkey", "is_duplicate")


for _name in _KEPT:
    _duplicates(_name, ["o_custkey", "o_orderstatus"], {})
    _duplicates(_name, ["o_orderstatus"], {"rows_per_task": CUT})


def _one_date(t):
    """The orders, all of one date: every row ties, and only a hash of the row can cut them into ranges."""
    return t("orders").select("o_orderkey", F.lit("2026-01-01").cast("date").alias("day"), F.lit(1).cast("bigint").alias("one"))


@query("SELECT row_number() OVER () AS running_total FROM orders")
def cumulative_sum_over_one_date(t):
    return rm.cumulative_sum(_one_date(t), "one", order_columns="day", rows_per_task=CUT).select("running_total")


@query("SELECT CAST(row_number() OVER () AS DOUBLE) AS rank FROM orders")
def rank_rows_first_over_one_date(t):
    return rm.rank_rows(_one_date(t), "one", method="first", order_columns="day", rows_per_task=CUT).select("rank")


@query("SELECT CASE WHEN row_number() OVER () > 1 THEN CAST(0 AS DOUBLE) END AS pct_change FROM orders")
def percent_change_over_one_date(t):
    return rm.percent_change(_one_date(t), "one", order_columns="day", rows_per_task=CUT).select("pct_change")
