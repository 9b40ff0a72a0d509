"""Whole step lists: the flagship, tidied lists and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import ORACLES, query

FLAGSHIP = [
    {"function": "calculate_column", "params": {
        "result_column": "reduction", "operator": "multiply", "left_column": "l_extendedprice", "right_column": "l_discount"}},
    {"function": "calculate_column", "params": {
        "result_column": "net", "operator": "subtract", "left_column": "l_extendedprice", "right_column": "reduction"}},
    {"function": "filter_by_conditions", "params": {"conditions": [
        {"column": "l_shipdate", "operator": ">=", "value": "1996-01-01"}, {"column": "l_shipdate", "operator": "<", "value": "1996-07-01"}]}},
    {"function": "group_aggregate", "params": {"group_columns": ["l_returnflag"], "aggregations": [
        {"column": "net", "function": "sum", "result_column": "net_sum"}, {"column": "net", "function": "mean", "result_column": "net_mean"},
        {"column": "net", "function": "count", "result_column": "lines"}]}},
    {"function": "sort_rows", "params": {"columns": ["net_sum"], "ascending": False}},
]


@query("""SELECT l_returnflag, round(sum(net), 2) AS net_sum, round(avg(net), 4) AS net_mean, count(net) AS lines FROM (
    SELECT l_returnflag, l_extendedprice - l_extendedprice * l_discount AS net FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01')
  GROUP BY l_returnflag ORDER BY net_sum DESC""")
def net_sales_by_return_flag(t):
    df = rm.apply_steps(t("lineitem"), FLAGSHIP)
    return df.select("l_returnflag", F.round("net_sum", 2).alias("net_sum"), F.round("net_mean", 4).alias("net_mean"), "lines")


@query("""SELECT CAST(1 AS INTEGER) AS step, 'calculate_column' AS function, (SELECT count(*) FROM lineitem) AS before_rows, (SELECT count(*) FROM lineitem) AS after_rows
  UNION ALL SELECT 2, 'calculate_column', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM lineitem)
  UNION ALL SELECT 3, 'filter_by_conditions', (SELECT count(*) FROM lineitem),
    (SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01')
  UNION ALL SELECT 4, 'group_aggregate', (SELECT count(*) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'),
    (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01')
  UNION ALL SELECT 5, 'sort_rows', (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01'),
    (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-07-01')""")
def preview_steps(t):
    return rm.preview_steps(t("lineitem"), FLAGSHIP).select("step", "function", "before_rows", "after_rows")


@query("""SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, max(o_orderdate) AS latest, count(*) AS n
  FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus""")
def normalize_steps(t):
    df = t("orders").withColumns({
        "priority": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        "o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
    })
    keep = {"function": "filter_rows", "params": {"column": "priority", "operator": "!=", "value": None}}
    steps = rm.normalize_steps([
        keep, keep,
        {"function": "group_aggregate", "params": {"group_columns": ["o_orderstatus"], "aggregations": [
            {"column": "o_totalprice", "function": "sum", "result_column": "total"}]}},
        {"function": "group_aggregate", "params": {"group_columns": ["o_orderstatus"], "aggregations": [
            {"column": "o_orderdate", "function": "max", "result_column": "latest"}]}},
        {"function": "group_count", "params": {"group_columns": ["o_orderstatus"], "result_column": "n"}},
        {"function": "sort_rows", "params": {"columns": ["o_totalprice"], "ascending": False}},
    ])
    return rm.apply_steps(df, steps).withColumn("total", F.col("total").cast("double"))


@query("""SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(*) AS n,
    CASE WHEN count(*) > 10 THEN 'green' END AS highlight FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1
  UNION ALL SELECT 'All', CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), count(*), NULL FROM orders
    WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'""")
def report_with_total_and_highlight(t):
    df = t("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    df = rm.apply_steps(df, [
        {"function": "filter_calendar_period", "params": {"column": "o_orderdate", "year": 1996}},
        {"function": "group_aggregate", "params": {"group_columns": ["o_orderstatus"], "aggregations": [
            {"column": "o_totalprice", "function": "sum", "result_column": "total"}, {"column": "o_orderkey", "function": "size", "result_column": "n"}]}},
        {"function": "add_total_row", "params": {"value_columns": ["total", "n"], "label": "All"}},
        {"function": "highlight_rows", "params": {"column": "n", "operator": ">", "value": 10, "color": "green"}},
    ])
    return df.select("o_orderstatus", F.col("total").cast("double").alias("total"), "n", "highlight")


@query(ORACLES["preview_steps"])
def check_steps(t):
    found = rm.check_steps(t("lineitem"), FLAGSHIP)
    return t.spark.createDataFrame(found, "step int, function string, before_rows bigint, after_rows bigint, affected_rows bigint, groups bigint").select(
        "step", "function", "before_rows", "after_rows"
    )


@query("""SELECT CAST(1 AS INTEGER) AS step, 'add_subtotals' AS function, (SELECT count(*) FROM orders) AS before_rows,
    (SELECT count(*) + count(DISTINCT o_custkey) + 1 FROM orders) AS after_rows, (SELECT count(DISTINCT o_custkey) FROM orders) AS groups, CAST(NULL AS BIGINT) AS affected_rows
  UNION ALL SELECT 2, 'highlight_rows', (SELECT count(*) + count(DISTINCT o_custkey) + 1 FROM orders), (SELECT count(*) + count(DISTINCT o_custkey) + 1 FROM orders), NULL,
    (SELECT count(*) FILTER (WHERE o_totalprice > 100000) + (SELECT count(*) FROM (SELECT sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS s FROM orders GROUP BY o_custkey) WHERE s > 100000) + 1 FROM orders)
  UNION ALL SELECT 3, 'add_total_row', (SELECT count(*) + count(DISTINCT o_custkey) + 1 FROM orders), (SELECT count(*) + count(DISTINCT o_custkey) + 2 FROM orders), NULL, NULL""")
def preview_steps_of_a_report(t):
    df = t("orders").select("o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"))
    return rm.preview_steps(df, [
        {"function": "add_subtotals", "params": {"group_columns": "o_custkey", "value_columns": "o_totalprice"}},
        {"function": "highlight_rows", "params": {"column": "o_totalprice", "operator": ">", "value": 100000, "color": "red"}},
        {"function": "add_total_row", "params": {"value_columns": ["o_totalprice"]}},
    ])


@query(ORACLES["preview_steps"])
def append_run_log(t):
    log = t.scratch()
    rm.append_run_log(t.spark, log, "done", FLAGSHIP, source="lineitem", preview=rm.check_steps(t("lineitem"), FLAGSHIP))
    entry = F.from_json("preview", "array<struct<step:int, function:string, before_rows:bigint, after_rows:bigint>>")
    return t.spark.read.json(log).where("status = 'done' AND source = 'lineitem'").select(F.explode(entry).alias("e")).select("e.*")
