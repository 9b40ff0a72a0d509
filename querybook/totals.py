"""Added rows, highlights, display formats and colour scales."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query

_PRICE = "CAST(o_totalprice AS DECIMAL(18, 2))"


def _orders(t):
    price = F.col("o_totalprice").cast("decimal(18,2)").alias("price")
    return t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", price)


def _plain(df, *columns):
    return df.select(*[F.col(c).cast("double").alias(c) if c == "price" else c for c in columns])


@query(f"""SELECT o_orderkey, o_orderstatus, CAST({_PRICE} AS DOUBLE) AS price, 'detail' AS kind,
    min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS place FROM orders
  UNION ALL SELECT NULL, 'Subtotal', CAST(sum({_PRICE}) AS DOUBLE), 'subtotal', min(o_orderkey) FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT NULL, 'Grand total', CAST(sum({_PRICE}) AS DOUBLE), 'grand_total', NULL FROM orders""")
def add_subtotals(t):
    df = rm.add_subtotals(_orders(t), "o_orderstatus", "price", order_columns="o_orderkey")
    df = _plain(df, "o_orderkey", "o_orderstatus", "price", "_row_kind", "_group_order")
    return df.withColumnsRenamed({"_row_kind": "kind", "_group_order": "place"})


@query(f"""SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST({_PRICE} AS DOUBLE) AS price FROM orders
  UNION ALL SELECT NULL, 'Sum', NULL, CAST(sum({_PRICE}) AS DOUBLE) FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def add_subtotals_by_two_keys(t):
    df = rm.add_subtotals(_orders(t), ["o_orderstatus", "o_orderpriority"], "price", label="Sum", include_grand_total=False)
    return _plain(df, "o_orderkey", "o_orderstatus", "o_orderpriority", "price")


_TOTALS = {
    "sum": f"CAST(sum({_PRICE}) AS DOUBLE)", "average": "round(avg(o_totalprice), 4)", "count": "CAST(count(o_totalprice) AS DOUBLE)",
    "min": "min(o_totalprice)", "max": "max(o_totalprice)",
}


def _total(aggregate, expression):
    @query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, round(o_totalprice, 4) AS price FROM orders
      UNION ALL SELECT 'All', NULL, {expression} FROM orders""", name=f"add_total_row_{aggregate}")
    def run(t):
        df = _orders(t) if aggregate == "sum" else _orders(t).withColumn("price", F.col("price").cast("double"))
        df = rm.add_total_row(df, "price", "All", aggregate)
        return df.select("o_orderkey", "o_orderpriority", F.round(F.col("price").cast("double"), 4).alias("price"))


for _aggregate, _expression in _TOTALS.items():
    _total(_aggregate, _expression)


_SUMMARIES = {
    "sum": f"CAST(coalesce(sum({_PRICE}) FILTER (WHERE {{test}}), 0) AS DOUBLE)",
    "count": "CAST(count(*) FILTER (WHERE {test}) AS DOUBLE)",
    "average": "round(avg(o_totalprice) FILTER (WHERE {test}), 4)",
}
_TESTS = {
    "one": ([{"column": "o_orderpriority", "operator": "!=", "value": "5-LOW"}], "o_orderpriority <> '5-LOW'"),
    "two": ([{"column": "o_orderstatus", "operator": "==", "value": "F"}, {"column": "o_orderpriority", "operator": "endswith", "value": "HIGH"}],
            "o_orderstatus = 'F' AND ends_with(o_orderpriority, 'HIGH')"),
}


def _summary(aggregate, tests):
    conditions, test = _TESTS[tests]

    @query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, round(o_totalprice, 4) AS price FROM orders
      UNION ALL SELECT 'Found', NULL, {_SUMMARIES[aggregate].format(test=test)} FROM orders""",
           name=f"add_conditional_summary_row_{aggregate}_{tests}")
    def run(t):
        df = _orders(t) if aggregate == "sum" else _orders(t).withColumn("price", F.col("price").cast("double"))
        df = rm.add_conditional_summary_row(
            df, aggregate, "price", conditions=conditions, value_column=None if aggregate == "count" else "price", label="Found",
        )
        return df.select("o_orderkey", "o_orderstatus", F.round(F.col("price").cast("double"), 4).alias("price"))


for _aggregate in _SUMMARIES:
    for _tests in _TESTS:
        _summary(_aggregate, _tests)


def _targets(df):
    return df.withColumn("targets", F.array_join("_highlight_targets", ",")).drop("_highlight_targets")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 450000 THEN 'red' WHEN o_orderstatus = 'F' THEN 'green' END AS highlight,
  CASE WHEN o_totalprice > 450000 THEN NULL WHEN o_orderstatus = 'F' THEN 'o_orderstatus,o_totalprice' END AS targets FROM orders""")
def highlight_rows(t):
    df = rm.highlight_rows(t("orders"), "o_orderstatus", "==", "F", "green", ["o_orderstatus", "o_totalprice"])
    df = rm.highlight_rows(df, "o_totalprice", ">", 450000, "red")
    return _targets(df).select("o_orderkey", "o_totalprice", "highlight", "targets")


_EXTREMES = {
    "max": (dict(mode="max"), "value = (SELECT max(value) FROM events)"),
    "min": (dict(mode="min"), "value = (SELECT min(value) FROM events)"),
    "top_n": (dict(mode="top_n", n=50), "value >= (SELECT min(value) FROM (SELECT value FROM events ORDER BY value DESC LIMIT 50))"),
    "bottom_n_without_ties": (
        dict(mode="bottom_n", n=50, include_ties=False, order_columns="event_id"),
        "event_id IN (SELECT event_id FROM events ORDER BY value, event_id LIMIT 50)",
    ),
}


def _extreme(name, options, test):
    @query(f"SELECT event_id, value, CASE WHEN {test} THEN 'yellow' END AS highlight FROM events", name=f"highlight_extremes_{name}")
    def run(t):
        return rm.highlight_extremes(t("events"), "value", color="yellow", **options).select("event_id", "value", "highlight")


for _name, _spec in _EXTREMES.items():
    _extreme(_name, *_spec)


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN 'gray' END AS highlight,
  CASE WHEN c_mktsegment = 'BUILDING' OR c_acctbal < 0 THEN concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'c_acctbal' END,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'c_mktsegment' END) END AS targets FROM customer""")
def highlight_missing(t):
    df = t("customer").withColumns({
        "c_mktsegment": F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")),
        "c_acctbal": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")),
    })
    return _targets(rm.highlight_missing(df, ["c_acctbal", "c_mktsegment"], "gray")).select("c_custkey", "highlight", "targets")


def _shown(factor, decimals):
    """Half-away rounding in SQL, without negative zero."""
    f = 10.0**decimals
    return f"(sign(x * {factor} * {f}) * floor(abs(x * {factor} * {f}) + 0.5) / {f} + 0.0)"


def _format_sql(name):
    prefix, comma, decimals, suffix, factor = {
        "currency": ("₩", ",", 0, "", 1.0), "thousands": ("", ",", 0, "", 1.0), "percent": ("", "", 2, "%", 100.0),
        "percent_points": ("", "", 2, "%", 1.0), **{f"decimal_{i}": ("", "", i, "", 1.0) for i in range(5)},
    }[name]
    value = _shown(factor, decimals)
    text = f"format('{{:{comma}.{decimals}f}}', abs({value}))"
    return f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || '{prefix}' || {text} || '{suffix}'"


def _format(name):
    @query(f"SELECT c_custkey, {_format_sql(name)} AS x_fmt FROM (SELECT c_custkey, c_acctbal AS x FROM customer)", name=f"format_numbers_{name}")
    def run(t):
        df = t("customer").select("c_custkey", F.col("c_acctbal").alias("x"))
        return rm.format_numbers(df, "x", name).drop("x")


for _name in ["currency", "thousands", "percent", "percent_points", *[f"decimal_{i}" for i in range(5)]]:
    _format(_name)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts_fmt FROM events")
def format_numbers_date(t):
    return rm.format_numbers(t("events"), "ts", "date").select("event_id", "ts_fmt")


@query("SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts_fmt FROM events")
def format_numbers_datetime(t):
    return rm.format_numbers(t("events"), "ts", "datetime").select("event_id", "ts_fmt")


def _channel(place, low, mid, high):
    down = f"floor({float(mid)} + ({low - mid}) * -scale + 0.5)"
    up = f"floor({float(mid)} + ({high - mid}) * scale + 0.5)"
    return f"printf('%02X', CAST(CASE WHEN scale <= 0 THEN {down} ELSE {up} END AS BIGINT))"


def _scale_sql():
    colors = ("F8696B", "FFEB84", "63BE7B")
    parts = [[int(c[i:i + 2], 16) for c in colors] for i in (0, 2, 4)]
    return " || ".join(_channel(i, *p) for i, p in enumerate(parts))


_SCALE = f"""SELECT event_id, scale AS value_scale, {_scale_sql()} AS value_color FROM (
  SELECT event_id, CASE WHEN value <= middle THEN (value - middle) / (middle - low) ELSE (value - middle) / (high - middle) END AS scale
  FROM events, (SELECT min(value) AS low, median(value) AS middle, max(value) AS high FROM events))"""


@query(_SCALE)
def color_scale(t):
    return rm.color_scale(t("events"), "value", "red_yellow_green").select("event_id", "value_scale", "value_color")


@query(_SCALE)
def color_scale_over_many_rows(t):
    df = rm.color_scale(t("events"), "value", "red_yellow_green")
    return df.select("event_id", "value_scale", "value_color")


@query("""SELECT o_orderstatus, CAST(o_totalprice AS DOUBLE) AS total, 'detail' AS kind FROM orders
  UNION ALL SELECT 'Subtotal', CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 'subtotal' FROM orders GROUP BY o_orderstatus
  UNION ALL SELECT 'Grand total', CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE), 'grand_total' FROM orders""")
def sort_with_totals(t):
    df = t("orders").select("o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    out = rm.sort_with_totals(rm.add_subtotals(df, "o_orderstatus", "total"))
    return out.select("o_orderstatus", F.col("total").cast("double").alias("total"), F.col("_row_kind").alias("kind"))
