import datetime as dt

import pytest

import rowmill as rm
from tests.conftest import values


@pytest.fixture
def sales(table):
    return table("amount bigint, region string", (10, "North"), (20, "South"), (30, "North"), (40, None))


@pytest.mark.parametrize("column, operator, value, expected", [
    ("amount", "between", [15, 35], [20, 30]), ("region", "in", ["North", "South"], [10, 20, 30]),
    ("region", "is_null", None, [40]), ("region", "not_null", None, [10, 20, 30]),
    ("region", "!=", "North", [20, 40]), ("region", "not_in", ["North"], [20, 40]),
    ("region", "not_in", ["North", None], [20]), ("region", "in", ["South", None], [20, 40]),
    ("amount", "==", 30, [30]), ("amount", "!=", 30, [10, 20, 40]), ("amount", ">", 20, [30, 40]), ("amount", "<=", 20, [10, 20]),
    ("amount", "==", "30", []), ("amount", "!=", "30", [10, 20, 30, 40]), ("amount", "in", ["30", 10], [10]),
    ("amount", "not_in", ["30"], [10, 20, 30, 40]), ("region", "==", 5, []), ("amount", "contains", "0", [10, 20, 30, 40]),
    ("amount", "startswith", 3, [30]), ("region", "contains", "th", [10, 20, 30]), ("region", "startswith", "So", [20]),
    ("region", "endswith", "TH", []), ("region", ">", "P", [20]),
])
def test_conditions(sales, column, operator, value, expected):
    assert sorted(values(rm.filter_rows(sales, column, operator, value), "amount")) == expected


@pytest.mark.parametrize("column, operator, value, error", [
    ("region", ">", 5, TypeError), ("amount", "between", ["a", "b"], TypeError), ("amount", "between", [1], ValueError),
    ("amount", "in", 3, ValueError), ("amount", "==", None, ValueError), ("amount", "==", [1], ValueError),
    ("amount", "like", "x", ValueError), ("absent", "==", 1, KeyError),
])
def test_conditions_refused(sales, column, operator, value, error):
    with pytest.raises(error):
        rm.filter_rows(sales, column, operator, value)


def test_nan_is_no_number(table):
    df = table("x double, i int", (float("nan"), 1), (5.0, 2), (None, 3))
    assert values(rm.filter_rows(df, "x", ">", 1), "i") == [2]
    assert values(rm.filter_rows(df, "x", "between", [0, 1e308]), "i") == [2]
    assert sorted(values(rm.filter_rows(df, "x", "!=", 5), "i")) == [1, 3]
    assert sorted(values(rm.filter_rows(df, "x", "is_null", None), "i")) == [1, 3]


def test_dates_compare_with_text(table):
    df = table("d timestamp_ntz, i int", (dt.datetime(2026, 1, 1), 1), (dt.datetime(2026, 1, 2, 5), 2), (None, 3))
    assert values(rm.filter_rows(df, "d", "==", "2026-01-01"), "i") == [1]
    assert values(rm.filter_rows(df, "d", ">", "2026-01-01"), "i") == [2]
    assert values(rm.filter_rows(df, "d", "in", ["2026-01-02 05:00:00"]), "i") == [2]
    assert values(rm.filter_rows(df, "d", "between", ["2026-01-01", "2026-01-02"]), "i") == [1]
    assert values(rm.filter_rows(df, "d", "startswith", "2026-01-02"), "i") == [2]


def test_blank_counts_as_empty(table):
    df = table("s string, i int", ("x", 1), ("  ", 2), (None, 3), ("", 4))
    assert sorted(values(rm.filter_rows(df, "s", "is_null", None), "i")) == [2, 3, 4]


@pytest.fixture
def payments(table):
    return table(
        "amount double, paid_date string, name string", (5.0, None, "A"), (50.0, "2026-01-01", "A"), (None, None, "B"),
        (500.0, None, "C"), (20.0, "2026-02-01", None),
    )


GROUPS = [
    {"conditions": [{"column": "amount", "operator": ">", "value": 10}, {"column": "paid_date", "operator": "is_null"}], "logic": "and"},
    {"conditions": [{"column": "name", "operator": "==", "value": "B"}]},
]


def test_nested_groups(payments):
    assert sorted(values(rm.filter_by_conditions(payments, condition_groups=GROUPS), "name")) == ["B", "C"]
    assert values(rm.filter_by_conditions(payments, condition_groups=GROUPS, group_logic="and"), "name") == []
    flag = rm.add_conditional_column(payments, "due", condition_groups=GROUPS, true_value="yes", false_value="no")
    assert values(flag, "due") == ["no", "no", "yes", "yes", "no"]


def test_flat_conditions(payments):
    flat = [{"column": "amount", "operator": ">=", "value": 50}, {"column": "name", "operator": "==", "value": "B"}]
    assert rm.filter_by_conditions(payments, flat).count() == 0
    assert rm.filter_by_conditions(payments, flat, logic="or").count() == 3
    for bad in (dict(), dict(conditions=flat, condition_groups=GROUPS), dict(conditions=flat, logic="xor")):
        with pytest.raises(ValueError):
            rm.filter_by_conditions(payments, **bad)


def test_conditional_column_values(payments):
    test = [{"column": "amount", "operator": ">", "value": 10}]
    assert values(rm.add_conditional_column(payments, "x", test, 1, None), "x") == [None, 1, None, 1, 1]
    with pytest.raises(TypeError):
        rm.add_conditional_column(payments, "x", test, 1, "no")


def test_comparisons_reach_the_scan(spark, tmp_path, payments):
    payments.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    out = rm.filter_by_conditions(df, [
        {"column": "amount", "operator": ">", "value": 10}, {"column": "name", "operator": "startswith", "value": "A"},
    ])
    plan = out.select("name")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(amount,10.0)" in plan and "StringStartsWith(name,A)" in plan
    assert "paid_date" not in plan
