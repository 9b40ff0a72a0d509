"""Rows: empties, duplicates, gaps, hidden rows and quality marks."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query

# Events with gaps: no type for errors, no value for clicks, and NaN for purchases above 20.
_EVENTS = """(SELECT event_id, nullif(event_type, 'error') AS event_type,
  CASE WHEN event_type = 'click' OR value > 20 THEN NULL ELSE value END AS value FROM events)"""


def _events(t):
    value = F.when(F.col("event_type") == "click", None).when(F.col("value") > 20, float("nan")).otherwise(F.col("value"))
    return t("events").select("event_id", F.nullif("event_type", F.lit("error")).alias("event_type"), value.alias("value"))


@query(f"SELECT event_type, value FROM {_EVENTS} WHERE event_type IS NOT NULL OR value IS NOT NULL")
def remove_empty_rows(t):
    df = rm.remove_empty_rows(_events(t).drop("event_id"))
    return df.withColumn("value", F.nanvl("value", F.lit(None)))


@query(f"SELECT * FROM {_EVENTS} WHERE event_type IS NOT NULL AND value IS NOT NULL")
def remove_empty_rows_any(t):
    return rm.remove_empty_rows(_events(t), how="any")


@query("SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def remove_duplicates_first(t):
    return rm.remove_duplicates(t("orders"), ["o_custkey"], order_columns=["o_orderdate", "o_orderkey"])


@query("""SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority
  ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def remove_duplicates_last(t):
    return rm.remove_duplicates(
        t("orders"), ["o_orderstatus", "o_orderpriority"], keep="last", order_columns=["o_orderdate", "o_orderkey"],
    )


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem")
def remove_duplicates_whole_rows(t):
    return rm.remove_duplicates(t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("SELECT * FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1")
def remove_duplicates_keeping_none(t):
    return rm.remove_duplicates(t("lineitem"), ["l_orderkey", "l_linenumber"], keep=False)


_BLANKS = """(SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '5-LOW' THEN '  ' ELSE o_orderpriority END AS priority,
  nullif(o_orderstatus, 'P') AS status FROM orders)"""


def _blanks(t):
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", None).when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(
        F.col("o_orderpriority")
    )
    return t("orders").select("o_orderkey", priority.alias("priority"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))


@query(f"SELECT * FROM {_BLANKS} WHERE trim(priority) <> '' OR trim(status) <> ''")
def drop_rows_missing_keys(t):
    return rm.drop_rows_missing_keys(_blanks(t), ["priority", "status"])


@query(f"SELECT * FROM {_BLANKS} WHERE trim(priority) <> '' AND trim(status) <> ''")
def drop_rows_missing_keys_all(t):
    return rm.drop_rows_missing_keys(_blanks(t), ["priority", "status"], require="all")


@query(f"""SELECT event_id, coalesce(event_type, 'unknown') AS event_type, coalesce(value, -1.0) AS value FROM {_EVENTS}""")
def fill_missing_values(t):
    return rm.fill_missing_values(_events(t), {"event_type": "unknown", "value": -1})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def select_visible_rows(t):
    hidden = F.when(F.col("o_orderstatus") == "P", True).when(F.col("o_orderstatus") == "F", False)
    return rm.select_visible_rows(t("orders").select("o_orderkey", "o_totalprice", hidden.alias("_hidden"))).drop("_hidden")


@query(f"""SELECT *, coalesce(trim(priority), '') = '' OR coalesce(trim(status), '') = '' AS is_missing_required,
  concat_ws(', ', CASE WHEN coalesce(trim(priority), '') = '' THEN 'priority' END,
  CASE WHEN coalesce(trim(status), '') = '' THEN 'status' END) AS missing_columns FROM {_BLANKS}""")
def mark_missing_required(t):
    return rm.mark_missing_required(_blanks(t), ["priority", "status"])


_ERRORS = """(SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN ' #N/A ' ELSE o_orderstatus END AS status,
  CASE o_orderpriority WHEN '1-URGENT' THEN '#DIV/0!' WHEN '2-HIGH' THEN '#NOPE!' ELSE o_orderpriority END AS priority FROM orders)"""


@query(f"""SELECT *, trim(status) = '#N/A' OR priority = '#DIV/0!' AS has_error,
  concat_ws('; ', CASE WHEN trim(status) = '#N/A' THEN 'status=' || status END,
  CASE WHEN priority = '#DIV/0!' THEN 'priority=' || priority END) AS error_detail FROM {_ERRORS}""")
def mark_error_values(t):
    status = F.when(F.col("o_orderstatus") == "P", " #N/A ").otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "#DIV/0!").when(F.col("o_orderpriority") == "2-HIGH", "#NOPE!")
    df = t("orders").select("o_orderkey", status.alias("status"), priority.otherwise(F.col("o_orderpriority")).alias("priority"))
    return rm.mark_error_values(df)


# Tables loaded with their source position: whole rows are compared without it.
_FLAGS = "(SELECT l_returnflag, nullif(l_linestatus, 'O') AS l_linestatus FROM lineitem)"


def _loaded_flags(t):
    df = rm.load_table(t.spark, t.path("lineitem"), include_source_metadata=True)
    kept = df.select("l_returnflag", F.nullif("l_linestatus", F.lit("O")).alias("l_linestatus"), "_source_file", "_source_row")
    return kept


@query(f"SELECT DISTINCT l_returnflag, l_linestatus FROM {_FLAGS}")
def remove_duplicates_of_a_loaded_table(t):
    return rm.remove_duplicates(_loaded_flags(t)).select("l_returnflag", "l_linestatus")


@query(f"SELECT l_returnflag, l_linestatus, count(*) - 1 AS later_copies FROM {_FLAGS} GROUP BY ALL")
def mark_duplicates_of_a_loaded_table(t):
    marked = rm.mark_duplicates(_loaded_flags(t), result_column="copy", keep="first", rows_per_task=5_000)
    return marked.groupBy("l_returnflag", "l_linestatus").agg(F.count_if("copy").alias("later_copies"))


@query(f"SELECT l_linestatus FROM {_FLAGS} WHERE l_linestatus IS NOT NULL")
def remove_empty_rows_of_a_loaded_table(t):
    return rm.remove_empty_rows(_loaded_flags(t).drop("l_returnflag")).select("l_linestatus")
