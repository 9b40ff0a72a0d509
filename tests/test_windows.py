"""Ordered windows against pandas, on data with one hot group, ties and nulls."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import rowmill as rm
from rowmill.plans.hot_ranges import Order, split
from rowmill.plans.selection import medians, values_at
from tests.conftest import rows

SIZES = [10_000, 15]  # plain windows, and groups cut into ranges


@pytest.fixture(scope="module")
def frame():
    rng = random.Random(3)
    data = []
    for i in range(400):
        group = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        value = None if rng.random() < 0.1 else float(rng.choice([0, 1, 2, 2, 2, 2, 2, 5, -3, rng.randint(0, 99)]))
        data.append((i, group, rng.randint(0, 40), value))
    rng.shuffle(data)
    return pd.DataFrame(data, columns=["id", "g", "day", "v"])


@pytest.fixture(scope="module")
def df(spark, frame):
    data = [(int(r.id), r.g, int(r.day), None if pd.isna(r.v) else r.v) for r in frame.itertuples()]
    return spark.createDataFrame(data, "id bigint, g string, day int, v double").repartition(5).cache()


def by_id(out, column):
    return {r[0]: r[1] for r in rows(out, "id", column)}


def same(got, ids, series):
    expected = dict(zip(ids, series))
    assert got.keys() == {int(i) for i in expected}
    for key, value in expected.items():
        if pd.isna(value):
            assert got[key] is None, key
        else:
            assert got[key] == pytest.approx(float(value)), key


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("groups", [None, ["g"]])
@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
def test_rank(df, frame, size, groups, ascending, method):
    ordered = frame.sort_values("id")
    source = ordered.groupby("g", dropna=False)["v"] if groups else ordered["v"]
    expected = source.rank(method=method, ascending=ascending)
    out = rm.rank_rows(
        df, "v", ascending=ascending, method=method, group_columns=groups, order_columns="id", rows_per_task=size,
    )
    same(by_id(out, "rank"), ordered["id"], expected)
    assert out.columns == [*df.columns, "rank"]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("groups", [None, ["g"], ["g", "day"]])
def test_cumulative_sum(df, frame, size, groups):
    ordered = frame.sort_values(["day", "id"])
    filled = ordered["v"].fillna(0)
    expected = filled.groupby([ordered[g] for g in groups], dropna=False).cumsum() if groups else filled.cumsum()
    out = rm.cumulative_sum(df, "v", group_columns=groups, order_columns=["day", "id"], rows_per_task=size)
    same(by_id(out, "running_total"), ordered["id"], expected)
    assert out.columns == [*df.columns, "running_total"]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("groups", [None, ["g"]])
@pytest.mark.parametrize("periods", [1, 3, 25, -2])
def test_percent_change(df, frame, size, groups, periods):
    ordered = frame.sort_values(["day", "id"])
    keys = [ordered[g] for g in groups] if groups else [pd.Series(0, index=ordered.index)]
    filled = ordered["v"].groupby(keys, dropna=False).ffill()
    before = filled.groupby(keys, dropna=False).shift(periods)
    with np.errstate(all="ignore"):
        expected = (filled / before - 1) * 100
    out = rm.percent_change(df, "v", group_columns=groups, order_columns=["day", "id"], periods=periods, rows_per_task=size)
    same(by_id(out, "pct_change"), ordered["id"], expected)
    assert out.columns == [*df.columns, "pct_change"]


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("keep", ["first", "last", False])
@pytest.mark.parametrize("subset", [["g"], ["g", "v"]])
def test_mark_duplicates(df, frame, size, keep, subset):
    ordered = frame.sort_values("id")
    expected = ordered.duplicated(subset, keep=keep)
    out = rm.mark_duplicates(df, subset, keep=keep, order_columns="id", rows_per_task=size)
    assert by_id(out, "is_duplicate") == {int(i): bool(x) for i, x in zip(ordered["id"], expected)}
    assert out.columns == [*df.columns, "is_duplicate"]


def test_median(df, frame):
    expected = frame.groupby("g", dropna=False)["v"].median()
    got = {g: m for g, m in rows(medians(df, "g", {"m": "v"}))}
    assert got == {None if pd.isna(g) else g: m for g, m in expected.items()}
    assert medians(df, None, {"m": "v"}).first()[0] == frame["v"].median()
    table = rm.group_aggregate(df, "g", [
        {"column": "v", "function": "median", "result_column": "m"}, {"column": "id", "function": "size", "result_column": "n"},
        {"column": "day", "function": "median", "result_column": "d"}, {"column": "v", "function": "nunique", "result_column": "u"},
    ])
    assert {r[0]: r[1] for r in rows(table)} == got
    assert table.columns == ["g", "m", "n", "d", "u"]


NUMBERS = [0.0, -0.0, 1.0, 1.0, -1.0, 5e-324, -5e-324, 1.7e308, -1.7e308, 0.1, 0.1 + 2**-56, 1e16, 1e16 + 2, float("inf"), float("-inf"), 3.0, 3.0, 3.0]


@pytest.mark.parametrize("parts", [2, 7, 65_536])
def test_every_place_of_every_double(spark, monkeypatch, parts):
    """Zeros, denormal and huge numbers, neighbours in the last bit, infinities and ties; also with few parts to a pass."""
    from rowmill.plans import selection

    monkeypatch.setattr(selection, "PARTS", parts)
    df = spark.createDataFrame([(v,) for v in [*NUMBERS, None, float("nan")]], "v double")
    n = len(NUMBERS)
    found = values_at(df, None, ["v"], lambda total: [F.lit(i) for i in range(n + 2)]).collect()
    assert [r["_value"] for r in sorted(found, key=lambda r: r["_place"])] == sorted(NUMBERS)
    assert {r["_total"] for r in found} == {n}


def test_places_in_groups_with_clashing_names(spark):
    data = [(i % 3 if i % 7 else None, float(i * 37 % 101) / 7, i % 5) for i in range(400)]
    df = spark.createDataFrame(data, "c int, v double, n int").withColumnsRenamed({"v": "lo", "n": "bucket"})
    found = {r["c"]: (r["a"], r["b"]) for r in medians(df, "c", {"a": "lo", "b": "bucket"}).collect()}
    frame = pd.DataFrame(data, columns=["c", "v", "n"])
    for key in (0, 1, 2, None):
        mine = frame[frame.c.isna()] if key is None else frame[frame.c == key]
        assert found[key] == (mine.v.median(), mine.n.median())
    assert medians(df.limit(0), None, {"a": "lo"}).collect()[0][0] is None
    assert medians(df.limit(0), "c", {"a": "lo"}).count() == 0


@pytest.fixture(scope="module")
def one_date(spark):
    """Rows of one date, half of them equal in every column."""
    return spark.range(8000, numPartitions=6).select(F.lit(dt.date(2026, 1, 1)).alias("day"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), F.lit(2).alias("v"))


def test_one_date_in_all_rows_is_cut(one_date):
    parts = split(one_date, None, [Order("day")], rows_per_task=1000, cut_ties=True)
    sizes = [r["count"] for r in parts.rows.groupBy("_range").count().collect()]
    assert sum(sizes) == 8000 and max(sizes) <= 2000
    assert parts.finish(parts.rows).columns == one_date.columns
    # what tells rows apart anyway needs nothing more
    assert "_tie" not in split(one_date.where("id is not null"), None, [Order("day"), Order("id")], 1000, cut_ties=True).rows.columns


@pytest.mark.parametrize("group", [None, "day"])
def test_windows_over_one_date(one_date, group):
    options = {"group_columns": group, "order_columns": "day", "rows_per_task": 1000}
    total = rm.cumulative_sum(one_date, "v", **options)
    assert sorted(r[0] for r in rows(total, "running_total")) == list(range(2, 16001, 2))
    ranked = rm.rank_rows(one_date, "day", method="first", **options)
    assert sorted(r[0] for r in rows(ranked, "rank")) == [float(i) for i in range(1, 8001)]
    for periods in (1, 3):
        change = [r[0] for r in rows(rm.percent_change(one_date, "v", periods=periods, **options), "pct_change")]
        assert change.count(None) == periods and change.count(0.0) == 8000 - periods
    # the order among ties is one order: changes multiply up to the last value over the first
    steps = one_date.withColumn("v", F.col("id").cast("double") % 7 + 1)
    both = rm.percent_change(rm.cumulative_sum(steps.withColumn("one", F.lit(1)), "one", "place", **options), "v", **options)
    assert both.count() == 8000
    marked = rm.mark_duplicates(one_date, "day", keep="first", order_columns="v", rows_per_task=1000)
    assert marked.where("not is_duplicate").count() == 1


def test_median_of_a_group_without_values(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", 2.0)], "g string, v double")
    table = rm.group_aggregate(df, "g", [{"column": "v", "function": "median", "result_column": "m"}])
    assert sorted(rows(table)) == [("a", None), ("b", 1.5)]


def test_hot_groups_are_cut_and_others_are_not(df):
    parts = split(df, ["g"], [Order("day"), Order("id")], rows_per_task=15)
    assert parts.hot
    sizes = parts.rows.groupBy("g", "_range").count().collect()
    hot = [r["count"] for r in sizes if r["g"] == "hot"]
    assert len(hot) > 8 and max(hot) <= 40
    assert not split(df, ["g"], [Order("id")], rows_per_task=1000).hot
    # Many small groups in a large table need no ranges.
    assert not split(df, ["id"], [Order("day")], rows_per_task=15).hot


def test_ranges_follow_the_order_in_mixed_directions(df):
    parts = split(df, None, [Order("v", False), Order("id")], rows_per_task=15)
    found = rows(parts.rows.select("_range", "v", "id"))
    found.sort(key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
    ranges = [r[0] for r in found]
    assert ranges == sorted(ranges) and len(set(ranges)) > 10


def test_integer_sums_stay_integers(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "i bigint, n int")
    out = rm.cumulative_sum(df, "n", order_columns="i")
    assert rows(out, order="i") == [(1, 5, 5), (2, None, 5), (3, 7, 12)]
    assert out.schema["running_total"].dataType.simpleString() == "bigint"


def test_change_from_zero_is_infinite(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 0.0), (4, 0.0), (5, -1.0)], "i bigint, n double")
    out = rm.percent_change(df, "n", order_columns="i")
    assert [r[2] for r in rows(out, order="i")] == [None, float("inf"), -100.0, None, float("-inf")]


@pytest.mark.parametrize("make", [
    lambda i: f"t{i % 7}", lambda i: dt.datetime(2026, 1, 1 + i % 7, i % 3), lambda i: dt.date(2026, 1, 1 + i % 7), lambda i: i % 3 == 0,
    lambda i: Decimal(i % 7) / 4, lambda i: -(2**63) + i % 7,
])
@pytest.mark.parametrize("ascending", [True, False])
def test_ranges_of_every_type(spark, make, ascending):
    data = [(i, None if i % 11 == 0 else make(i)) for i in range(200)]
    kind = {str: "string", dt.datetime: "timestamp_ntz", dt.date: "date", bool: "boolean", Decimal: "decimal(10,2)", int: "bigint"}
    df = spark.createDataFrame(data, f"id bigint, v {kind[type(make(1))]}")
    out = rm.rank_rows(df, "v", ascending=ascending, method="first", order_columns="id", rows_per_task=10)
    ordered = sorted((r for r in data if r[1] is not None), key=lambda r: r[0])
    ordered.sort(key=lambda r: r[1], reverse=not ascending)  # stable: ties stay by id
    expected = {r[0]: float(n) for n, r in enumerate(ordered, start=1)} | {r[0]: None for r in data if r[1] is None}
    assert by_id(out, "rank") == expected
    assert split(df, None, [Order("v", ascending), Order("id")], 10).hot
