import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import rowmill as rm
from rowmill.plans.selection import nth_value
from tests.conftest import rows, values


@pytest.fixture
def clients(table):
    return table("client string, amount bigint", ("A", 100), ("B", 50), ("A", 20), (None, None))


def test_sum_average_count(clients):
    assert sorted(rows(rm.group_sum(clients, "client", "amount")), key=str) == [("A", 120), ("B", 50), (None, 0)]
    assert sorted(rows(rm.group_average(clients, "client", "amount")), key=str) == [("A", 60.0), ("B", 50.0), (None, None)]
    assert sorted(rows(rm.group_count(clients, ["client"])), key=str) == [("A", 2), ("B", 1), (None, 1)]
    with pytest.raises(TypeError):
        rm.group_sum(clients, "amount", "client")


def test_sum_then_sort(clients):
    out = rm.sort_rows(rm.group_sum(clients, "client", "amount", "total"), "total", ascending=False)
    assert rows(out) == [("A", 120), ("B", 50), (None, 0)]


def test_sort_puts_nulls_last_both_ways(table):
    df = table("x double, i int", (None, 1), (2.0, 2), (float("nan"), 3), (1.0, 4))
    assert values(rm.sort_rows(df, "x"), "i")[:2] == [4, 2]
    assert values(rm.sort_rows(df, ["x", "i"], [False, False]), "i") == [2, 4, 3, 1]
    with pytest.raises(ValueError):
        rm.sort_rows(df, ["x", "i"], [True])


def test_named_aggregates(table):
    df = table("g string, v double, s string", ("a", 1.0, "x"), ("a", None, "x"), ("a", 4.0, None), ("b", float("nan"), "y"))
    wanted = ["sum", "mean", "count", "size", "nunique", "min", "max", "median"]
    out = rm.group_aggregate(df, "g", [{"column": "v", "function": f, "result_column": f} for f in wanted])
    assert sorted(rows(out)) == [("a", 5.0, 2.5, 2, 3, 2, 1.0, 4.0, 2.5), ("b", 0.0, None, 0, 1, 0, None, None, None)]
    texts = rm.group_aggregate(df, "g", [
        {"column": "s", "function": "nunique", "result_column": "n"}, {"column": "s", "function": "max", "result_column": "m"},
    ])
    assert sorted(rows(texts)) == [("a", 1, "x"), ("b", 1, "y")]
    rough = rm.group_aggregate(df, "g", [
        {"column": "v", "function": "nunique", "result_column": "n"}, {"column": "v", "function": "median", "result_column": "m"},
    ], approximate=True)
    assert sorted(rows(rough))[0] == ("a", 2, 1.0)


@pytest.mark.parametrize("aggregations", [
    [], [{"column": "v", "function": "mode", "result_column": "x"}], [{"column": "s", "function": "sum", "result_column": "x"}],
    [{"column": "v", "function": "sum", "result_column": "x"}, {"column": "v", "function": "min", "result_column": "x"}],
])
def test_named_aggregates_refused(table, aggregations):
    with pytest.raises((ValueError, TypeError)):
        rm.group_aggregate(table("g string, v double, s string", ("a", 1.0, "x")), "g", aggregations)


@pytest.fixture
def shops(table):
    return table(
        "store string, item string, qty bigint", ("A", "pencil", 2), ("A", "pencil", 3), ("A", "pad", 4), ("B", "pencil", 7),
    )


def test_pivot_sum(shops):
    out = rm.pivot_table(shops, "store", "item", "qty")
    assert out.columns == ["store", "pad", "pencil"]
    assert sorted(rows(out)) == [("A", 4, 5), ("B", 0, 7)]
    assert rm.pivot_table(shops, "store", "item", "qty", fill_value=None).filter("pad is null").count() == 1
    with pytest.raises(ValueError):
        rm.pivot_table(shops, "store", "store", "qty")
    with pytest.raises(TypeError):
        rm.pivot_table(shops, "store", "qty", "item")
    with pytest.raises(ValueError, match="more than 1"):
        rm.pivot_table(shops, "store", "item", "qty", max_values=1)


def test_pivot_of_several_values(table):
    df = table("company string, month int, sales bigint, fee bigint", ("A", 1, 100, 10), ("A", 2, 200, 20), ("B", 1, 50, 5))
    out = rm.pivot_table(df, "company", "month", ["sales", "fee"])
    assert out.columns == ["company", "fee 1", "fee 2", "sales 1", "sales 2"]
    assert sorted(rows(out)) == [("A", 10, 20, 100, 200), ("B", 5, 0, 50, 0)]


def test_pivot_null_rules(table):
    df = table(
        "g string, p string, v double", ("a", "x", 1.0), ("a", "y", None), ("b", "y", None), (None, "x", 5.0), ("c", None, 6.0),
    )
    assert sorted(rows(rm.pivot_table(df, "g", "p", "v", fill_value=-1))) == [("a", 1.0, 0.0), ("b", -1.0, 0.0)]
    means = rm.pivot_table(df, "g", "p", "v", "mean")
    assert means.columns == ["g", "x"] and rows(means) == [("a", 1.0)]
    counts = rm.pivot_table(df, "g", "p", "v", "count")
    assert sorted(rows(counts)) == [("a", 1, 0), ("b", 0, 0)]


def test_pivot_by_date(table):
    df = table("g string, d timestamp_ntz, v int", ("a", dt.datetime(2026, 1, 2), 1), ("a", dt.datetime(2026, 1, 1), 2))
    assert rm.pivot_table(df, "g", "d", "v", "max").columns == ["g", "2026-01-01", "2026-01-02"]


def test_pivot_of_listed_values_and_of_all(table):
    df = table("g string, d timestamp_ntz, v int", *[("a", dt.datetime(2026, 1, d), d) for d in (1, 2, 3)])
    assert rows(rm.pivot_table(df, "g", "d", "v", "mean", pivot_values=["2026-01-03", "2026-01-05"], fill_value=None)) == [("a", 3.0, None)]
    assert rows(rm.pivot_table(df, "g", "d", "v", "mean", fill_value=None)) == [("a", 1.0, 2.0, 3.0)]


def test_every_day_of_the_events_is_a_column():
    from querybook import ORACLES

    assert all(f"2024-01-{d:02}" in ORACLES["pivot_table_mean_by_every_day"] for d in range(1, 31))


def test_top_n(table):
    df = table("x double, i int", (5.0, 1), (7.0, 2), (7.0, 3), (None, 4), (float("nan"), 5))
    assert values(rm.select_top_n(df, "x", 2, order_columns="i"), "i") == [2, 3]
    assert values(rm.select_top_n(df, "x", 2, largest=False, order_columns="i"), "i") == [1, 2]
    assert values(rm.select_top_n(df, "x", 4, order_columns="i"), "i") == [2, 3, 1, 4]
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            rm.select_top_n(df, "x", bad)
    with pytest.raises(TypeError):
        rm.select_top_n(table("s string", ("a",)), "s")


@pytest.mark.parametrize("largest", [True, False])
def test_long_top_n_of_many_rows(spark, largest):
    df = spark.range(20_000).selectExpr("id", "pmod(id * 7919, 5003) AS x")
    plain = rm.select_top_n(df, "x", 3000, largest, "id")
    reached = rm.select_top_n(df, "x", 3000, largest, "id", rows_per_task=100)
    assert sorted(rows(plain)) == sorted(rows(reached))
    limit = nth_value(df, "x", 3000, largest).first()
    assert limit["_total"] == 20_000 and limit["_value"] == sorted((r["x"] for r in df.collect()), reverse=largest)[2999]
    # Fewer values than asked for: nulls fill up.
    gaps = df.withColumn("x", F.when(F.col("id") % 10 == 0, F.col("x")))
    assert rm.select_top_n(gaps, "x", 3000, largest, "id", rows_per_task=100).count() == 3000


def test_sorting_spreads_a_common_value(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("id", "'same' AS g")
    plain = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[0] for r in rm.sort_rows(df, "g").groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", plain)
    assert len(sizes) == 4 and max(sizes) < 8000


def test_latest_per_group(table):
    df = table(
        "customer string, date string, v int", ("A", "2026-01-01", 1), ("A", "2026-02-01", 2), ("A", "2026-02-01", 3),
        ("B", "2026-03-01", 4), (None, "2026-01-01", 5), (None, None, 6),
    )
    assert sorted(values(rm.keep_latest_per_group(df, "customer", "date", order_columns="v"), "v")) == [3, 4, 5]
    assert sorted(values(rm.keep_latest_per_group(df, "customer", "date", keep_ties=True), "v")) == [2, 3, 4, 5]
    undated = table("customer string, date string, v int", ("A", None, 1))
    for ties in (True, False):
        with pytest.raises(PySparkException, match="without a date"):
            rm.keep_latest_per_group(undated, "customer", "date", ties, order_columns="v").collect()


def test_latest_limits_each_key_before_the_shuffle(table):
    df = table("customer string, date timestamp_ntz, v int", ("A", dt.datetime(2026, 1, 1), 1))
    out = rm.keep_latest_per_group(df, "customer", "date", order_columns="v")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    out = rm.remove_duplicates(df, "customer", order_columns="v")
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
