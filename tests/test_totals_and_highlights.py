import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import rowmill as rm
from tests.conftest import rows, values


@pytest.fixture
def groups(table):
    return table("i int, region string, amount bigint", (1, "b", 10), (2, "a", 20), (3, "b", 30), (4, None, 5))


def test_subtotals_by_first_appearance(groups):
    out = rm.sort_with_totals(rm.add_subtotals(groups, "region", "amount", order_columns="i"), "i")
    assert rows(out, "region", "amount", "_row_kind", "_group_order") == [
        ("b", 10, "detail", 1), ("b", 30, "detail", 1), ("Subtotal", 40, "subtotal", 1),
        ("a", 20, "detail", 2), ("Subtotal", 20, "subtotal", 2),
        (None, 5, "detail", 4), ("Subtotal", 5, "subtotal", 4), ("Grand total", 65, "grand_total", None),
    ]


def test_subtotals_by_key(groups):
    out = rm.add_subtotals(groups, ["region"], ["amount"], label="Sum", include_grand_total=False)
    assert rows(rm.sort_with_totals(out, "i"), "region", "amount", "_group_order") == [
        ("a", 20, "a"), ("Sum", 20, "a"), ("b", 10, "b"), ("b", 30, "b"), ("Sum", 40, "b"), (None, 5, None), ("Sum", 5, None),
    ]


def test_subtotals_of_numeric_groups_and_text_values(table):
    df = table("g int, h int, v string", (1, 1, "2"), (1, 1, "x"), (1, 2, "3"))
    out = rm.sort_with_totals(rm.add_subtotals(df, ["g", "h"], "v"), "v")
    assert rows(out, "g", "h", "v") == [
        ("1", 1, "2"), ("1", 1, "x"), ("Subtotal", None, "2.0"), ("1", 2, "3"), ("Subtotal", None, "3.0"), ("Grand total", None, "5.0"),
    ]


def scans(df):
    """How often the plan reads the files of a table."""
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "stored")
    spark.range(100).selectExpr("id", "id % 7 AS g", "cast(id AS double) AS v").write.parquet(path)
    return spark.read.parquet(path)


def test_subtotals_and_grand_total_take_two_scans(stored):
    out = rm.add_subtotals(stored, "g", ["v", "g"])
    assert scans(out) == 2
    assert out.where("_row_kind = 'grand_total'").select("v").first()[0] == 4950.0
    assert scans(rm.add_subtotals(stored, "g", "v", order_columns="id")) == 3  # the table once; what one pass has written twice
    empty = rm.add_subtotals(stored.limit(0), "g", "v")
    assert rows(empty, "g", "v", "_row_kind") == [("Grand total", 0.0, "grand_total")]
    assert rm.add_subtotals(stored.limit(0), "g", "v", include_grand_total=False).count() == 0


def test_summary_rows_share_one_scan(stored):
    out = rm.add_total_row(stored, ["v"], label="Total")
    for n in (10, 20, 30):
        out = rm.add_conditional_summary_row(out, "sum", "v", "g", "<", n, value_column="v", label=f"below {n}")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("scalar-subquery#") == 4 and len(set(re.findall(r"AS mergedValue#\d+", plan))) == 1
    assert [r["v"] for r in rm.sort_with_totals(out).collect()[100:]] == [4950.0] * 4


def test_sorting_with_totals_spreads_a_group(spark):
    df = spark.range(0, 15_000, 1, 4).selectExpr("id", "'g' AS g", "1 AS v")
    out = rm.sort_with_totals(rm.add_subtotals(df, "g", "v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put so few rows together
    try:
        sizes = [r["count"] for r in out.select("*", F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 4 and max(sizes) < 6000
    assert [r["_row_kind"] for r in out.collect()[-2:]] == ["subtotal", "grand_total"]


@pytest.fixture
def items(table):
    return table("item string, amount int, note string", ("x", 10, None), ("y", 20, "n"), ("z", None, "  "))


@pytest.mark.parametrize("aggregate, expected", [("sum", 30), ("average", 15.0), ("count", 2), ("min", 10), ("max", 20)])
def test_total_row(items, aggregate, expected):
    out = rm.add_total_row(items, "amount", "Total", aggregate)
    assert rows(out.filter("_row_kind = 'summary'"), "item", "amount", "note") == [("Total", expected, None)]
    assert out.count() == 4


def test_totals_do_not_add_each_other_up(items):
    out = rm.add_total_row(rm.add_total_row(items, ["amount", "note"], "First"), ["amount", "note"], "Second", "count")
    out = rm.add_conditional_summary_row(out, "count", "amount", "amount", ">", 5, label="Third")
    got = rows(rm.sort_with_totals(out, "item"), "item", "amount", "note", "_summary_order")
    assert got[3:] == [("First", 30, "0.0", 1), ("Second", 2, "2", 2), ("Third", 2, None, 3)]


def test_totals_leave_subtotals_out(groups):
    out = rm.add_total_row(rm.add_subtotals(groups, "region", "amount"), "amount")
    assert values(out.filter("_row_kind = 'summary'"), "amount") == [65]


@pytest.fixture
def cases(table):
    return table(
        "status string, region string, amount int", ("open", "N", 10), ("done", "N", 20), ("open", "S", 40), (None, "N", 80),
    )


@pytest.mark.parametrize("options, expected", [
    (dict(aggregate="sum", value_column="amount", condition_column="status", operator="==", value="open"), 50),
    (dict(aggregate="count", condition_column="status", operator="is_null", value=None), 1),
    (dict(aggregate="average", value_column="amount", condition_column="status", operator="!=", value="done"), 130 / 3),
    (dict(aggregate="sum", value_column="amount", conditions=[
        {"column": "status", "operator": "==", "value": "open"}, {"column": "region", "operator": "startswith", "value": "N"}]), 10),
    (dict(aggregate="sum", value_column="amount", condition_column="status", operator="==", value="none"), 0),
    (dict(aggregate="average", value_column="amount", condition_column="status", operator="==", value="none"), None),
])
def test_conditional_summary(cases, options, expected):
    out = rm.add_conditional_summary_row(cases, output_column="amount", label="Found", **options)
    row = rows(out.filter("_row_kind = 'summary'"), "status", "amount")[0]
    assert row[0] == "Found" and (row[1] == pytest.approx(expected) if expected is not None else row[1] is None)


@pytest.mark.parametrize("options", [
    dict(aggregate="sum", condition_column="status", operator="==", value="x"),
    dict(aggregate="max", value_column="amount", condition_column="status", operator="==", value="x"),
    dict(aggregate="count"), dict(aggregate="count", conditions=[]),
    dict(aggregate="count", condition_column="amount", operator="in", value=[1]),
    dict(aggregate="count", condition_column="amount", operator=">", value=1, conditions=[{"column": "amount", "operator": ">", "value": 1}]),
])
def test_conditional_summary_refused(cases, options):
    with pytest.raises(ValueError):
        rm.add_conditional_summary_row(cases, output_column="amount", **options)


def test_highlight_rows_and_targets(cases):
    df = rm.highlight_rows(cases, "amount", ">", 15, "yellow")
    df = rm.highlight_rows(df, "status", "==", "open", "red", target_columns=["status"])
    assert rows(df, "highlight", "_highlight_targets", order="amount") == [
        ("red", ["status"]), ("yellow", None), ("red", ["status"]), ("yellow", None),
    ]
    for bad in (dict(color="pink"), dict(color="red", target_columns=["_x"]), dict(color="red", target_columns=["absent"])):
        with pytest.raises((ValueError, KeyError)):
            rm.highlight_rows(cases.withColumn("_x", F.lit(1)), "amount", ">", 1, **bad)


@pytest.fixture
def scores(table):
    return table("i int, x double", (1, 5.0), (2, 9.0), (3, 9.0), (4, None), (5, 1.0), (6, 5.0))


@pytest.mark.parametrize("options, expected", [
    (dict(mode="max"), [2, 3]), (dict(mode="min"), [5]), (dict(mode="top_n", n=3), [1, 2, 3, 6]), (dict(mode="top_n", n=1), [2, 3]),
    (dict(mode="top_n", n=1, include_ties=False), [2]), (dict(mode="top_n", n=3, include_ties=False), [1, 2, 3]),
    (dict(mode="bottom_n", n=2, include_ties=False), [1, 5]), (dict(mode="bottom_n", n=2), [1, 5, 6]),
    (dict(mode="top_n", n=99), [1, 2, 3, 5, 6]), (dict(mode="top_n", n=99, include_ties=False), [1, 2, 3, 5, 6]),
])
def test_highlight_extremes(scores, options, expected):
    out = rm.highlight_extremes(scores, "x", color="green", order_columns="i", **options)
    assert sorted(values(out.filter("highlight = 'green'"), "i")) == expected


def test_highlight_extremes_needs_numbers(table):
    df = table("i int, s string", (1, "x"))
    for mode in ("max", "top_n"):
        with pytest.raises(PySparkException, match="no numbers"):
            rm.highlight_extremes(df, "s", mode, "red").collect()


def test_highlight_missing(items):
    out = rm.highlight_missing(items, ["amount", "note"], "gray")
    assert rows(out, "highlight", "_highlight_targets", order="item") == [
        ("gray", ["note"]), (None, None), ("gray", ["amount", "note"]),
    ]


@pytest.mark.parametrize("format, expected", [
    ("currency", ["₩1,234,568", "-₩3", "₩0", None]), ("thousands", ["1,234,568", "-3", "0", None]),
    ("percent", ["123456750.00%", "-250.00%", "-0.10%", None]), ("percent_points", ["1234567.50%", "-2.50%", "0.00%", None]),
    ("decimal_0", ["1234568", "-3", "0", None]), ("decimal_1", ["1234567.5", "-2.5", "0.0", None]),
    ("decimal_4", ["1234567.5000", "-2.5000", "-0.0010", None]),
])
def test_number_formats(table, format, expected):
    df = table("i int, x double", (1, 1234567.5), (2, -2.5), (3, -0.001), (4, None))
    assert values(rm.format_numbers(df, "x", format), "x_fmt", order="i") == expected


def test_date_formats(table):
    df = table("d string", ("2026-01-02 03:04:05",))
    assert values(rm.format_numbers(df, "d", "date"), "d_fmt") == ["2026-01-02"]
    assert values(rm.format_numbers(df, "d", "datetime"), "d_fmt") == ["2026-01-02 03:04:05"]
    with pytest.raises(ValueError):
        rm.format_numbers(df, "d", "roman")


def test_color_scale(scores):
    out = rm.color_scale(scores, "x", "red_yellow_green")
    assert rows(out, "x_scale", "x_color", order="i") == [
        (0.0, "FFEB84"), (1.0, "63BE7B"), (1.0, "63BE7B"), (None, None), (-1.0, "F8696B"), (0.0, "FFEB84"),
    ]


def test_color_scale_of_one_value_and_of_none(table):
    assert rows(rm.color_scale(table("x int", (3,)), "x", "blue_white"), "x_scale", "x_color") == [(0.0, "FFFFFF")]
    with pytest.raises(PySparkException, match="no numbers"):
        rm.color_scale(table("x double", (None,)), "x", "blue_white").collect()
