"""Loading, combining, locating and writing tables; profiles and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import rowmill as rm
from querybook.base import query


@query("SELECT o_orderkey, o_totalprice, o_orderkey + 1 AS source_row FROM orders")
def load_table(t):
    df = rm.load_table(t.spark, t.path("orders"), include_source_metadata=True)
    return df.select("o_orderkey", "o_totalprice", F.col("_source_row").alias("source_row"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def load_table_in_file_order(t):
    df = rm.load_table(t.spark, t.path("orders"), include_source_metadata=True)
    return rm.remove_duplicates(df, "o_custkey", keep="last").select("o_orderkey", "o_orderstatus")


@query("SELECT label, note FROM (SELECT nullif(o_orderstatus, 'P') AS label, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS note FROM orders) WHERE label IS NOT NULL OR trim(note) <> ''")
def load_table_without_blank_rows(t):
    from rowmill.sources.load import drop_blank_rows

    note = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    return drop_blank_rows(t("orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("label"), note.alias("note")))


@query("""SELECT 'customers' AS source_table, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer
  UNION ALL SELECT 'suppliers', s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def combine_tables(t):
    customers = t("customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
    )
    suppliers = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return rm.combine_tables({"customers": customers, "suppliers": suppliers})


@query("""SELECT 'customer.parquet' AS source_file, 'customer' AS source_table, *, NULL AS s_suppkey, NULL AS s_name, NULL AS s_nationkey,
    NULL AS s_acctbal FROM customer
  UNION ALL BY NAME SELECT 'supplier.parquet' AS source_file, 'supplier' AS source_table, * FROM supplier""")
def combine_files(t):
    return rm.combine_files(t.spark, [t.path("customer"), t.path("supplier")])


@query("SELECT 'a' AS source_table, c_name, c_acctbal, c_mktsegment FROM customer UNION ALL SELECT 'b', c_name, c_acctbal, c_mktsegment FROM customer")
def combine_tables_with_aliases(t):
    first = t("customer").select("c_name", "c_acctbal", "c_mktsegment")
    second = first.withColumnsRenamed({"c_mktsegment": "segment"})
    aliases = rm.infer_column_aliases(first.columns, [second.columns])
    mapping = {other: name for name, others in aliases.items() for other in others}
    both = rm.combine_tables({"a": first, "b": second})
    return rm.normalize_column_names(both, mapping)


@query("SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders")
def write_result(t):
    target = t.scratch()
    df = t("orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.lit(1).alias("_internal"))
    rm.write_result(df, target, "csv", source_paths=t.path("orders"))
    return rm.load_table(t.spark, target, "csv", schema="o_orderkey bigint, o_totalprice double, o_orderdate string")


_HEADERS = ["c_name", "c_mktsegment", "balance"]


def _customer_cells(t):
    """The customers as a raw grid: a title, a gap, headers in row 3, the rows, and a note further down."""
    customers = t("customer")
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col"), value.alias("value"))
        for i, value in enumerate([F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal").cast("string")], start=1)
    ])).alias("cell")
    place = [F.lit("book").alias("file"), F.lit("customers").alias("sheet")]
    body = customers.select(*place, (F.col("c_custkey") + 4).alias("row"), cells).select("file", "sheet", "row", "cell.*")
    edge = customers.agg(F.max("c_custkey").alias("last"))
    fixed = [F.struct(F.lit(1).cast("long").alias("row"), F.lit(1).alias("col"), F.lit("[Customers]").alias("value"))]
    fixed += [F.struct(F.lit(3).cast("long").alias("row"), F.lit(i).alias("col"), F.lit(h).alias("value")) for i, h in enumerate(_HEADERS, 1)]
    fixed += [F.struct((F.col("last") + 8).alias("row"), F.lit(i).alias("col"), F.lit(v).alias("value")) for i, v in enumerate(["end", "of list"], 1)]
    frame = edge.select(*place, F.explode(F.array(*fixed)).alias("cell")).select("file", "sheet", "cell.*")
    return body.unionByName(frame)


@query("""SELECT 'book' AS file, 'customers' AS sheet, CAST(3 AS BIGINT) AS header_row, CAST(1 AS BIGINT) AS start_col, CAST(3 AS BIGINT) AS end_col,
  CAST(4 AS BIGINT) AS data_start_row, max(c_custkey) + 4 AS data_end_row, 'c_name,c_mktsegment,balance' AS headers,
  count(*) AS filled_rows, CAST(1 AS DOUBLE) AS confidence FROM customer""")
def find_table_regions(t):
    return rm.find_table_regions(_customer_cells(t)).withColumn("headers", F.array_join("headers", ","))


@query("SELECT c_custkey + 4 AS source_row, c_name, c_mktsegment, c_acctbal AS balance FROM customer")
def read_region(t):
    cells = _customer_cells(t)
    df = rm.read_region(cells, rm.find_table_regions(cells), _HEADERS)
    df = rm.convert_column_type(df, "balance", "number")
    return df.select(F.col("_source_row").alias("source_row"), *_HEADERS)


_WIDE = 105


def _supplier_cells(t):
    """The suppliers as a wide grid below 297 rows of notes: names and 104 numbers in columns 1 to 105."""
    place = [F.lit("book").alias("file"), F.lit("suppliers").alias("sheet")]
    texts = [F.col("s_name"), *[(F.col("s_suppkey") + i).cast("string") for i in range(2, _WIDE + 1)]]
    body = t("supplier").select(*place, (F.col("s_suppkey") + 301).alias("row"), F.posexplode(F.array(*texts)))
    body = body.select("file", "sheet", "row", (F.col("pos") + 1).alias("col"), F.col("col").alias("value"))
    heads = F.array(F.lit("s_name"), *[F.lit(f"plus {i}") for i in range(2, _WIDE + 1)])
    head = t.spark.range(1).select(*place, F.lit(300).cast("long").alias("row"), F.posexplode(heads))
    head = head.select("file", "sheet", "row", (F.col("pos") + 1).alias("col"), F.col("col").alias("value"))
    notes = t.spark.range(1, 298).select(*place, F.col("id").alias("row"), F.lit(1).alias("col"), F.lit("note").alias("value"))
    return body.unionByName(head).unionByName(notes)


@query(f"""SELECT 300 AS header_row, {_WIDE} AS end_col, {_WIDE} AS names, max(s_suppkey) + 301 AS data_end_row, count(*) AS filled_rows FROM supplier""")
def find_table_regions_wide_and_late(t):
    found = rm.find_table_regions(_supplier_cells(t))
    return found.select("header_row", "end_col", F.size("headers").alias("names"), "data_end_row", "filled_rows")


@query(f"""SELECT s_suppkey + 301 AS source_row, s_name, CAST(s_suppkey + 2 AS VARCHAR) AS "plus 2", CAST(s_suppkey + {_WIDE} AS VARCHAR) AS "plus {_WIDE}",
  {_WIDE} AS filled FROM supplier""")
def read_region_wide_and_late(t):
    cells = _supplier_cells(t)
    headers = ["s_name", *[f"plus {i}" for i in range(2, _WIDE + 1)]]
    df = rm.read_region(cells, rm.find_table_regions(cells), headers)
    filled = sum(F.col(f"`{h}`").isNotNull().cast("int") for h in headers)
    return df.select(F.col("_source_row").alias("source_row"), "s_name", "plus 2", f"plus {_WIDE}", filled.alias("filled"))


def _profile_sql(table, order, columns):
    parts = []
    for name, kind, type_name in columns:
        value = name if kind == "text" else f"strftime({name}, '%Y-%m-%d')" if kind == "date" else f"CAST({name} AS VARCHAR)"
        number = kind == "number"
        if kind == "text":
            top = f"""(SELECT string_agg(v || ':' || n, ';' ORDER BY n DESC, first) FROM (SELECT {name} AS v, count(*) AS n, min({order}) AS first
              FROM {table} GROUP BY 1 ORDER BY n DESC, first LIMIT 3))"""
            top = f"CASE WHEN count(DISTINCT {name}) <= greatest(20, count(*) / 2) THEN {top} END"
        else:
            top = "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{name}' AS "column", '{type_name}' AS "type", count(*) AS row_count, count(*) - count({name}) AS missing_count,
          count(DISTINCT {name}) AS unique_count,
          (SELECT string_agg(v, ';' ORDER BY first) FROM (SELECT {value} AS v, min({order}) AS first FROM {table} GROUP BY 1 ORDER BY 2 LIMIT 3)) AS samples,
          {f'CAST(min({name}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS "min", {f'CAST(max({name}) AS DOUBLE)' if number else 'NULL'} AS "max",
          {f'round(CAST(sum({name}) AS DOUBLE), 2)' if number else 'NULL'} AS "sum", {f'round(avg({name}), 4)' if number else 'NULL'} AS "mean",
          {f'CAST(median({name}) AS DOUBLE)' if number else 'NULL'} AS "median",
          {f'count(*) FILTER (WHERE {name} = 0)' if number else 'NULL'} AS zero_count,
          {f'count(*) FILTER (WHERE {name} < 0)' if number else 'NULL'} AS negative_count,
          {f"strftime(min({name}), '%Y-%m-%d')" if kind == 'date' else 'CAST(NULL AS VARCHAR)'} AS min_date,
          {f"strftime(max({name}), '%Y-%m-%d')" if kind == 'date' else 'NULL'} AS max_date,
          {f'round(count(DISTINCT {name}) / count(*), 4)' if kind == 'text' else 'CAST(NULL AS DOUBLE)'} AS unique_ratio,
          {f'round(avg(length({name})), 2)' if kind == 'text' else 'NULL'} AS average_length,
          {'CAST(0 AS DOUBLE)' if kind == 'text' else 'NULL'} AS numeric_parse_ratio, {'CAST(0 AS DOUBLE)' if kind == 'text' else 'NULL'} AS datetime_parse_ratio,
          {top} AS tops FROM {table}""")
    return " UNION ALL ".join(parts)


def _flat_profile(df):
    tops = F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit(":"), x["count"].cast("string"))), ";")
    return df.withColumns({
        "samples": F.array_join("sample_values", ";"), "tops": tops, "sum": F.round("sum", 2), "mean": F.round("mean", 4),
    }).drop("sample_values", "top_values")


_ORDER_COLUMNS = [
    ("o_orderkey", "number", "bigint"), ("o_custkey", "number", "bigint"), ("o_orderstatus", "text", "string"),
    ("o_totalprice", "number", "double"), ("o_orderdate", "date", "timestamp_ntz"), ("o_orderpriority", "text", "string"),
]


@query(_profile_sql("orders", "o_orderkey", _ORDER_COLUMNS))
def profile_table(t):
    return _flat_profile(rm.profile_table(t("orders"), order_columns="o_orderkey"))


@query(_profile_sql("orders", "o_orderkey", _ORDER_COLUMNS))
def profile_table_of_many_rows(t):
    return _flat_profile(rm.profile_table(t("orders"), order_columns="o_orderkey", rows_per_task=2000))


_REQUEST = "documents in fr or de from src1, not SRC12 or esrc2"


@query(f"""SELECT "column", "value", row_count FROM (
    SELECT 'lang' AS "column", lang AS "value", count(*) AS row_count FROM documents GROUP BY lang
    UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source
    UNION ALL SELECT 'text', text, count(*) FROM documents WHERE length(text) BETWEEN 2 AND {len(_REQUEST)} GROUP BY text)
  WHERE regexp_matches('{_REQUEST.lower()}', '(^|[^a-z0-9_])' || regexp_escape(lower("value")) || '($|[^a-z0-9_])') ORDER BY length("value") DESC, "column", "value" """)
def find_values(t):
    return rm.find_values(t("documents"), _REQUEST, minimum_length=2)


_CANDIDATES = """WITH cells AS (
  SELECT 'p_name' AS "column", p_name AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part),
wanted AS (SELECT DISTINCT "column", substr(v, strpos(lower(v), f), length(f)) AS f FROM cells, (VALUES ('red'), ('ing'), ('economy'), ('zzz')) AS fragments(f) WHERE contains(lower(v), f)),
pairs AS (SELECT "column", v, f FROM cells JOIN wanted USING ("column")),
counts AS (SELECT "column", f, count(*) FILTER (WHERE v = f) AS n0, count(*) FILTER (WHERE contains(v, f)) AS n1,
  count(*) FILTER (WHERE starts_with(v, f)) AS n2, count(*) FILTER (WHERE ends_with(v, f)) AS n3,
  count(*) FILTER (WHERE starts_with(v, f) AND ends_with(v, f)) AS n23 FROM pairs GROUP BY 1, 2)
SELECT "column", '==' AS operator, f AS "value", n0 AS row_count FROM counts WHERE n0 > 0
UNION ALL SELECT "column", 'contains', f, n1 FROM counts WHERE n1 > 0 AND n1 <> n0
UNION ALL SELECT "column", 'startswith', f, n2 FROM counts WHERE n2 > 0 AND n2 NOT IN (n0, n1)
UNION ALL SELECT "column", 'endswith', f, n3 FROM counts WHERE n3 > 0 AND n3 NOT IN (n0, n1) AND NOT (n2 = n23 AND n3 = n23)"""


@query(_CANDIDATES)
def find_filter_candidates(t):
    df = rm.find_filter_candidates(t("part"), fragments=["red", "ing", "ECONOMY", "zzz"], columns=["p_name", "p_type"], minimum_length=2)
    return df.drop("matched_values")


@query("""SELECT 'o_orderpriority' AS "column", 'endswith' AS operator, 'LOW' AS "value", count(*) AS row_count FROM orders
  WHERE o_orderpriority = '5-LOW' AND FALSE HAVING count(*) > 0
  UNION ALL SELECT 'o_orderpriority', 'contains', 'LOW', count(*) FROM orders WHERE o_orderpriority = '5-LOW'
  UNION ALL SELECT 'o_orderpriority', 'contains', 'URGENT', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def find_filter_candidates_in_a_request(t):
    df = rm.find_filter_candidates(t("orders"), text="LOW, URGENT", columns=["o_orderpriority"], minimum_length=3)
    return df.drop("matched_values")


@query("""SELECT 'contains' AS operator, 'LOW' AS "value", count(*) AS row_count FROM orders WHERE contains(o_orderpriority, 'LOW')
  UNION ALL SELECT 'contains', 'URGENT', count(*) FROM orders WHERE contains(o_orderpriority, 'URGENT')""")
def filter_rows_with_each_candidate(t):
    found = rm.find_filter_candidates(t("orders"), text="low, urgent", columns=["o_orderpriority"], minimum_length=3)
    parts = [
        rm.filter_rows(t("orders"), "o_orderpriority", c["operator"], c["value"]).agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(c["operator"]).alias("operator"), F.lit(c["value"]).alias("value"), "row_count")
        for c in found.collect()  # one row per candidate
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("SELECT c_name, c_mktsegment, c_acctbal AS balance, c_custkey FROM customer")
def cells_from_csv(t):
    target = t.scratch()
    headers = [*_HEADERS, "c_custkey"]
    rm.write_result(t("customer").withColumnRenamed("c_acctbal", "balance").select(*headers), target, "csv")
    cells = rm.cells_from_csv(t.spark, target, width=10)
    df = rm.read_region(cells, rm.find_table_regions(cells), headers)
    df = rm.convert_column_type(rm.convert_column_type(df, "balance", "number"), "c_custkey", "number")
    return df.select("c_name", "c_mktsegment", "balance", F.col("c_custkey").cast("bigint").alias("c_custkey"))


@query("SELECT c_name, c_mktsegment, c_acctbal AS balance, c_custkey FROM customer")
def cells_from_csv_of_any_width(t):
    target = t.scratch()
    headers = [*_HEADERS, "c_custkey"]
    table = t("customer").withColumnRenamed("c_acctbal", "balance").select(*headers)
    table.write.csv(target, header=True, sep=";")
    cells = rm.cells_from_csv(t.spark, target, delimiter=";")
    df = rm.read_region(cells, rm.find_table_regions(cells), headers)
    df = rm.convert_column_type(rm.convert_column_type(df, "balance", "number"), "c_custkey", "number")
    return df.select("c_name", "c_mktsegment", "balance", F.col("c_custkey").cast("bigint").alias("c_custkey"))


@query("SELECT o_orderstatus, CAST(sum(o_custkey) AS BIGINT) AS total, min(strftime(o_orderdate, '%Y-%m-%d')) AS first_day FROM orders GROUP BY 1")
def load_csv_with_types(t):
    target = t.scratch()
    rm.write_result(t("orders").select("o_orderstatus", "o_custkey", "o_orderdate"), target, "csv")
    df = rm.load_table(t.spark, target, "csv", infer_types=True)
    df = rm.group_aggregate(df, "o_orderstatus", [
        {"column": "o_custkey", "function": "sum", "result_column": "total"}, {"column": "o_orderdate", "function": "min", "result_column": "first_day"}])
    return df.withColumn("first_day", F.date_format("first_day", "yyyy-MM-dd"))


@query("""SELECT 'even' AS source_file, 'even' AS source_table, c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'odd', 'odd', c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 2 = 1""")
def combine_csv_files_of_two_layouts(t):
    base, customers = t.scratch(), t("customer")
    customers.where("c_custkey % 2 = 0").select("c_custkey", "c_name").write.csv(f"{base}/even", header=True)
    customers.where("c_custkey % 2 = 1").select("c_name", "c_acctbal", "c_custkey").write.csv(f"{base}/odd", header=True)
    df = rm.combine_files(t.spark, [f"{base}/even", f"{base}/odd"], "csv", infer_types=True)
    return df.select("source_file", "source_table", "c_custkey", "c_name", "c_acctbal")


@query("""SELECT 'even' AS source_file, c_custkey, CAST(c_nationkey AS VARCHAR) AS nation FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT 'odd', c_custkey, 'n' || c_nationkey FROM customer WHERE c_custkey % 2 = 1""")
def combine_files_of_clashing_kinds(t):
    base, customers = t.scratch(), t("customer")
    customers.where("c_custkey % 2 = 0").selectExpr("cast(c_custkey AS int) AS c_custkey", "cast(c_nationkey AS int) AS nation").write.parquet(f"{base}/even")
    customers.where("c_custkey % 2 = 1").selectExpr("c_custkey", "concat('n', c_nationkey) AS nation").write.parquet(f"{base}/odd")
    return rm.combine_files(t.spark, [f"{base}/even", f"{base}/odd"]).select("source_file", "c_custkey", "nation")


@query("""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS source_file, c_custkey FROM customer WHERE c_acctbal >= 0""")
def combine_files_without_hidden_rows(t):
    base = t.scratch()
    customers = t("customer").selectExpr("c_custkey", "c_acctbal < 0 AS hide")
    for name, odd in (("even", 0), ("odd", 1)):
        customers.where(F.col("c_custkey") % 2 == odd).write.parquet(f"{base}/{name}")
    df = rm.combine_files(t.spark, [f"{base}/even", f"{base}/odd"], hidden_column="hide", include_hidden_rows=False)
    return df.select("source_file", "c_custkey")


@query("""SELECT 'o_orderstatus' AS "column", o_orderstatus AS "value", count(*) AS row_count FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_orderstatus""")
def find_values_of_one_letter(t):
    return rm.find_values(t("orders"), "how many have status f, and how many o?")


@query(r"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '\S')")
def cells_from_csv_with_line_breaks(t):
    target = t.scratch()
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    t("documents").select("doc_id", "text").write.options(quoteAll=True, **options).csv(target)
    cells = rm.cells_from_csv(t.spark, target, width=2, rows_per_task=2000, escape='"')
    cell = lambda i: F.max(F.when(F.col("col") == i, F.col("value")))
    found = cells.groupBy("file", "row").agg(cell(1).cast("bigint").alias("doc_id"), cell(2).alias("text"))
    return found.where("text IS NOT NULL").select("doc_id", "text")
