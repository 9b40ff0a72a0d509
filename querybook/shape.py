"""Columns and text."""

from __future__ import annotations

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query


@query("SELECT c_name, c_custkey FROM customer")
def select_columns(t):
    return rm.select_columns(t("customer"), ["c_name", "c_custkey"])


@query("SELECT o_orderdate, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def reorder_columns(t):
    return rm.reorder_columns(t("orders"), ["o_orderdate"])


@query("SELECT o_orderdate, o_orderkey FROM orders")
def reorder_columns_dropping_the_rest(t):
    return rm.reorder_columns(t("orders"), ["o_orderdate", "o_orderkey"], keep_remaining=False)


@query("SELECT p_partkey, p_name, p_size FROM part")
def drop_columns(t):
    return rm.drop_columns(t("part"), ["p_brand", "p_type", "p_retailprice"])


@query("""SELECT c_custkey, c_name AS name, c_nationkey, c_acctbal,
  coalesce(nullif(c_mktsegment, 'BUILDING'), 'old ' || c_mktsegment) AS segment FROM customer""")
def normalize_column_names(t):
    df = t("customer").withColumns({
        "segment": F.nullif("c_mktsegment", F.lit("BUILDING")), "c_mktsegment": F.concat(F.lit("old "), "c_mktsegment"),
    })
    return rm.normalize_column_names(df, {"c_name": "name", "c_mktsegment": "segment"})


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS balance FROM customer""")
def convert_column_type_number(t):
    balance = F.when(F.col("c_mktsegment") == "BUILDING", "n/a").otherwise(F.concat(F.lit("  "), F.col("c_acctbal").cast("string")))
    return rm.convert_column_type(t("customer").select("c_custkey", balance.alias("balance")), "balance", "number", errors="coerce")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts FROM events""")
def convert_column_type_datetime(t):
    df = rm.convert_column_type(t("events").select("event_id", "event_type", "ts"), "ts", "string")
    df = df.withColumn("ts", F.when(F.col("event_type") == "error", "2024-99-99").otherwise(F.col("ts"))).drop("event_type")
    return rm.convert_column_type(df, "ts", "datetime", errors="coerce")


@query("SELECT o_orderkey, o_orderdate FROM orders")
def convert_column_type_datetime_format(t):
    text = F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")
    df = t("orders").select("o_orderkey", text.alias("o_orderdate"))
    return rm.convert_column_type(df, "o_orderdate", "datetime", date_format="%d.%m.%Y %H:%M")


@query("SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS ts FROM events")
def convert_column_type_date(t):
    return rm.convert_column_type(t("events").select("event_id", "ts"), "ts", "date")


@query("""SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def convert_column_type_string(t):
    df = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return rm.convert_column_type(rm.convert_column_type(df, "o_totalprice", "string"), "o_orderdate", "string")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN TRUE WHEN '2-HIGH' THEN TRUE
  WHEN '4-NOT SPECIFIED' THEN FALSE WHEN '5-LOW' THEN FALSE END AS fast FROM orders""")
def convert_column_type_boolean(t):
    words = {"1-URGENT": " Yes", "2-HIGH": "예", "4-NOT SPECIFIED": "아니오 ", "5-LOW": "FALSE"}
    df = rm.replace_values(t("orders").select("o_orderkey", F.col("o_orderpriority").alias("fast")), "fast", words)
    return rm.convert_column_type(df, "fast", "boolean", errors="coerce")


# DuckDB's \s is ASCII only, so the other white space is spelled out.
_SPACE = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(rf"""SELECT doc_id, upper(regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')) AS text
  FROM (SELECT doc_id, replace(text, 'ß', 'ss') AS text FROM documents)""")
def normalize_text(t):
    df = t("documents").select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text"))
    return rm.normalize_text(df, "text", case="upper")


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'STANDARD' WHEN 'STANDARD' THEN 'LARGE' ELSE p_type END AS p_type FROM part""")
def replace_values(t):
    df = t("part").select("p_partkey", "p_type")
    return rm.replace_values(df, "p_type", {"ECONOMY": "STANDARD", "STANDARD": "LARGE"})


@query("""SELECT n_nationkey, CASE WHEN n_nationkey < 60 THEN 'N' || n_nationkey ELSE n_name END AS n_name FROM nation""")
def replace_values_large_map(t):
    names = {f"NATION_{i}": f"N{i}" for i in range(60)}
    return rm.replace_values(t("nation").select("n_nationkey", "n_name"), "n_name", names)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 60 THEN l_quantity * 10 ELSE l_quantity END AS l_quantity FROM lineitem")
def replace_values_whole_numbers_in_a_double_column(t):
    return rm.replace_values(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", {i: i * 10 for i in range(1, 61)})


@query("SELECT page_id, replace(html, '</p>', '<br>') AS html FROM pages")
def replace_text(t):
    return rm.replace_text(t("pages").select("page_id", "html"), "html", "</p>", "<br>")


@query(r"SELECT doc_id, regexp_replace(text, 'the\.', '$the', 'gi') AS text FROM documents")
def replace_text_ignoring_case(t):
    return rm.replace_text(t("documents").select("doc_id", "text"), "text", "the.", "$the", case_sensitive=False)


@query("SELECT url, CASE WHEN instr(url, '//') > 0 THEN left(url, instr(url, '//') - 1) ELSE url END AS part FROM pages")
def extract_text_before(t):
    return rm.extract_text(t("pages").select("url"), "url", "part", "before", delimiter="//")


@query("""SELECT url, CASE WHEN contains(url, '/') THEN
  left(url, length(url) - length(list_last(string_split(url, '/'))) - 1) ELSE url END AS part FROM pages""")
def extract_text_before_last(t):
    return rm.extract_text(t("pages").select("url"), "url", "part", "before", delimiter="/", occurrence="last")


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS part FROM customer")
def extract_text_after(t):
    df = rm.extract_text(t("customer"), "c_name", "part", "after", delimiter="#")
    return rm.select_columns(df, ["c_custkey", "part"])


@query("""SELECT url, CASE WHEN contains(url, '/') THEN list_last(string_split(url, '/')) END AS part FROM pages""")
def extract_text_after_last(t):
    return rm.extract_text(t("pages").select("url"), "url", "part", "after", delimiter="/", occurrence="last")


@query("""SELECT url, CASE WHEN contains(url, '//') THEN
  split_part(substr(url, instr(url, '//') + 2), '/', 1) END AS part FROM pages""")
def extract_text_between(t):
    return rm.extract_text(t("pages").select("url"), "url", "part", "between", start_delimiter="//", end_delimiter="/")


@query("SELECT doc_id, left(text, 12) AS head, right(text, 7) AS tail FROM documents")
def extract_text_left_and_right(t):
    df = rm.extract_text(t("documents").select("doc_id", "text"), "text", "head", "left", length=12)
    return rm.extract_text(df, "text", "tail", "right", length=7).drop("text")


@query("""SELECT p_partkey, split_part(p_name, ' ', 1) AS adjective,
  CASE WHEN contains(p_name, ' ') THEN substr(p_name, instr(p_name, ' ') + 1) END AS noun FROM part""")
def split_column(t):
    return rm.split_column(t("part").select("p_partkey", "p_name"), "p_name", ["adjective", "noun"], " ", drop_source=True)


@query("""SELECT c_custkey, concat_ws('|', c_name, nullif(c_mktsegment, 'BUILDING'), CAST(c_acctbal AS VARCHAR),
  CAST(c_nationkey AS VARCHAR)) AS label FROM customer""")
def combine_columns(t):
    df = t("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    df = rm.combine_columns(df, ["c_name", "c_mktsegment", "c_acctbal", "c_nationkey"], "label", separator="|")
    return rm.select_columns(df, ["c_custkey", "label"])


@query("""SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '') || '-' || strftime(o_orderdate, '%Y-%m-%d') AS label FROM orders""")
def combine_columns_keeping_blanks(t):
    df = t("orders").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.col("o_orderstatus")))
    df = rm.combine_columns(df, ["o_orderstatus", "o_orderdate"], "label", separator="-", skip_missing=False)
    return rm.select_columns(df, ["o_orderkey", "label"])
