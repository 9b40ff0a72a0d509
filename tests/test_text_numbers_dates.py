import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException

import rowmill as rm
from tests.conftest import rows, values


def test_normalize_text_cases_and_options(table):
    df = table("s string", (" A 　 b\n",), (None,))
    assert values(rm.normalize_text(df, "s", case="upper"), "s") == ["A B", None]
    assert values(rm.normalize_text(df, "s", strip=False, case="lower"), "s") == [" a b ", None]
    assert values(rm.normalize_text(df, "s", collapse_whitespace=False), "s") == ["A 　 b", None]


def test_replace_values_is_not_chained(table):
    df = table("s string", ("a",), ("b",), ("c",), (None,))
    assert values(rm.replace_values(df, "s", {"a": "b", "b": "c"}), "s") == ["b", "c", "c", None]
    assert values(rm.replace_values(df, "s", {None: "-", "a": None}), "s") == [None, "b", "c", "-"]


def test_replace_values_by_type(table):
    df = table("n bigint", (1,), (2,))
    assert values(rm.replace_values(df, "n", {"1": 9}), "n") == [1, 2]
    assert values(rm.replace_values(df, "n", {1: 9}), "n") == [9, 2]
    assert values(rm.replace_values(df, "n", {1: 0.5}), "n") == [0.5, 2.0]
    with pytest.raises(TypeError):
        rm.replace_values(df, "n", {1: "x"})


def test_replace_values_with_a_large_map(table):
    df = table("s string, n bigint", *[(f"k{i}", i) for i in range(100)], (None, -1), ("other", -2))
    got = dict(rows(rm.replace_values(df, "s", {f"k{i}": f"v{i}" for i in range(80)}), "n", "s"))
    assert got == {i: f"v{i}" if i < 80 else f"k{i}" for i in range(100)} | {-1: None, -2: "other"}


def test_replace_text_is_literal(table):
    df = table("s string", ("(주)Corp",), ("ACME.LTD",), ("acme.ltd",), ("100",))
    df = rm.replace_text(df, "s", "(주)", "")
    assert values(rm.replace_text(df, "s", ".ltd", "", case_sensitive=False), "s") == ["Corp", "ACME", "acme", "100"]
    assert values(rm.replace_text(df, "s", "acme", r"$1\E", case_sensitive=False), "s")[1:3] == [r"$1\E.LTD", r"$1\E.ltd"]
    with pytest.raises(ValueError):
        rm.replace_text(df, "s", "")
    assert values(rm.replace_text(table("n bigint", (11,)), "n", "1", "2"), "n") == [11]


@pytest.mark.parametrize("options, expected", [
    (dict(mode="before", delimiter="-"), ["AB", "none"]),
    (dict(mode="before", delimiter="-", occurrence="last"), ["AB-123", "none"]),
    (dict(mode="after", delimiter="-"), ["123-X", None]),
    (dict(mode="after", delimiter="-", occurrence="last"), ["X", None]),
    (dict(mode="between", start_delimiter="-", end_delimiter="-"), ["123", None]),
    (dict(mode="between", start_delimiter="-", end_delimiter="#"), ["123-X", None]),
    (dict(mode="left", length=2), ["AB", "no"]),
    (dict(mode="right", length=3), ["3-X", "one"]),
])
def test_extract_text(table, options, expected):
    df = table("s string, i int", ("AB-123-X", 1), ("none", 2), (None, 3))
    assert values(rm.extract_text(df, "s", "part", **options), "part", order="i") == [*expected, None]


@pytest.mark.parametrize("options", [
    dict(mode="middle"), dict(mode="before"), dict(mode="left"), dict(mode="left", length=0),
    dict(mode="between", start_delimiter="-"), dict(mode="before", delimiter="-", occurrence="second"),
])
def test_extract_text_refuses(table, options):
    with pytest.raises(ValueError):
        rm.extract_text(table("s string", ("x",)), "s", "part", **options)


def test_split_column(table):
    df = table("s string, i int", ("AB-123-N", 1), ("CD-456-S-E", 2), ("EF", 3), (None, 4))
    out = rm.split_column(df, "s", ["a", "b", "c"], "-", drop_source=True)
    assert out.columns == ["i", "a", "b", "c"]
    assert rows(out, "a", "b", "c", order="i") == [
        ("AB", "123", "N"), ("CD", "456", "S-E"), ("EF", None, None), (None, None, None),
    ]
    with pytest.raises(ValueError, match="exist"):
        rm.split_column(df, "s", ["i", "b"], "-")


def test_combine_columns(table):
    df = table("last string, first string, code int", ("Kim", "Min", 1), ("Park", None, 2), (" ", None, None))
    out = rm.combine_columns(df, ["last", "first", "code"], "name", "-")
    assert values(out, "name") == ["Kim-Min-1", "Park-2", ""]
    out = rm.combine_columns(df, ["last", "first", "code"], "name", "-", skip_missing=False)
    assert values(out, "name") == ["Kim-Min-1", "Park--2", "--"]


def test_clean_numeric_values(table):
    df = table(
        "amount string, ratio string", ("1,200", "12.5%"), ("₩3,000", "100%"), ("(450)", None), ("USD 20", "0%"),
        ("5원", "50%"), (" € -7.5 ", " "), ("(-3)", "(5%)"), ("krw1", "1"),
    )
    out = rm.clean_numeric_values(rm.clean_numeric_values(df, "amount"), "ratio", percent_as_fraction=True)
    assert values(out, "amount") == [1200, 3000, -450, 20, 5, -7.5, -3, 1]
    assert values(out, "ratio") == [0.125, 1.0, None, 0.0, 0.5, None, -0.05, 1.0]
    bad = table("amount string", ("12 apples",))
    assert values(rm.clean_numeric_values(bad, "amount", errors="coerce"), "amount") == [None]
    with pytest.raises(PySparkException, match="amount"):
        rm.clean_numeric_values(bad, "amount").collect()


def test_rounding_goes_away_from_zero(table):
    df = table("x double", (2.5,), (-2.5,), (149.0,), (151.0,), (1e300,), (float("inf"),), (None,))
    assert values(rm.round_numbers(df, "x"), "x") == [3, -3, 149, 151, 1e300, math.inf, None]
    assert values(rm.round_numbers(df, "x", -1), "x")[:4] == [0, 0, 150, 150]
    assert values(rm.round_numbers(df, "x", mode="floor"), "x")[:2] == [2, -3]
    assert values(rm.round_numbers(df, "x", mode="ceil"), "x")[:2] == [3, -2]
    assert values(rm.round_numbers(table("x double", (1.005,)), "x", 2), "x") == [1.0]
    with pytest.raises(PySparkException):
        rm.round_numbers(table("x string", ("a",)), "x").collect()
    with pytest.raises(ValueError):
        rm.round_numbers(df, "x", 11)


@pytest.mark.parametrize("operator, expected", [
    ("add", [12, None, None]), ("subtract", [8, None, None]), ("multiply", [20, 0, None]),
    ("divide", [5, None, None]), ("percent_of", [500, None, None]), ("absolute_difference", [8, None, None]),
])
def test_calculate_column(table, operator, expected):
    df = table("a double, b string", (10.0, "2"), (3.0, "0"), (1.0, "x"))
    got = values(rm.calculate_column(df, "r", operator, "a", right_column="b"), "r")
    expected = [3 if e is None and operator in ("add", "subtract", "absolute_difference") and i == 1 else e for i, e in enumerate(expected)]
    assert got == expected


def test_calculate_with_a_constant(table):
    df = table("a bigint", (10,))
    assert values(rm.calculate_column(df, "r", "divide", "a", value=4), "r") == [2.5]
    assert values(rm.calculate_column(df, "r", "divide", "a", value=0), "r") == [None]
    for extra in ({}, {"right_column": "a", "value": 1}):
        with pytest.raises(ValueError):
            rm.calculate_column(df, "r", "add", "a", **extra)


def test_date_differences(table):
    df = table("s string, e string", ("2026-01-15", "2026-02-16"), ("2026-01-31", "2026-03-30"), ("2026-03-30", "2026-01-31"), (None, "2026-01-01"))

    def diff(**options):
        return values(rm.calculate_date_difference(df, "s", "e", "d", **options), "d")

    assert diff() == [32, 58, -58, None]
    assert diff(unit="weeks")[0] == pytest.approx(32 / 7)
    assert diff(unit="months") == [1, 1, -1, None]
    assert diff(unit="months", absolute=True) == [1, 1, 1, None]
    assert diff(absolute=True)[2] == 58
    leap = table("s string, e string", ("2024-01-31", "2024-02-29"))
    assert values(rm.calculate_date_difference(leap, "s", "e", "d", unit="months"), "d") == [0]
    out = rm.calculate_date_difference(df, "s", result_column="d", end_mode="today", today="2026-02-01")
    assert values(out, "d") == [17, 1, -57, None]
    with pytest.raises(PySparkException, match="not a date"):
        rm.calculate_date_difference(table("s string", ("soon",)), "s", end_mode="today").collect()
    with pytest.raises(ValueError):
        rm.calculate_date_difference(df, "s", "e", end_mode="today")


def test_date_parts(table):
    df = rm.add_date_parts(table("d string", ("2026-01-01",), ("2024-12-30",), ("x",)), "d", ["year", "quarter", "month", "week", "day", "weekday"])
    assert rows(df)[0][1:] == (2026, 1, 1, 1, 1, 4)
    assert rows(df)[1][1:] == (2024, 4, 12, 1, 30, 1)
    assert rows(df)[2][1:] == (None,) * 6
    assert df.columns[1] == "d_year"


TODAY = dt.datetime(2026, 3, 15)


@pytest.mark.parametrize("period, days, expected", [
    ("today", None, [1]), ("last_n_days", 5, [1, 2]), ("older_than_n_days", 30, [4, 5, 7, 8]), ("this_month", None, [1, 2, 3]),
    ("last_month", None, [5, 6]), ("this_year", None, [1, 2, 3, 5, 6]), ("last_year", None, [4, 7]),
])
@pytest.mark.parametrize("as_text", [False, True])
def test_relative_dates(table, period, days, expected, as_text):
    moments = [
        TODAY + dt.timedelta(hours=23), TODAY - dt.timedelta(4), TODAY - dt.timedelta(14), dt.datetime(2025, 1, 1),
        dt.datetime(2026, 2, 1), dt.datetime(2026, 2, 28, 23, 59), dt.datetime(2025, 12, 31, 12), dt.datetime(2024, 12, 31),
    ]
    df = table("d timestamp_ntz, v int", *[(m, i) for i, m in enumerate(moments, start=1)])
    if as_text:
        df = rm.convert_column_type(df, "d", "string")
    out = rm.filter_relative_dates(df, "d", period, days=days, today="2026-03-15")
    assert sorted(values(out, "v")) == expected


def test_relative_dates_use_the_clock_by_default(table):
    df = table("d timestamp, v int", (dt.datetime.now(dt.timezone.utc), 1), (dt.datetime(2000, 1, 1), 2))
    assert values(rm.filter_relative_dates(df, "d", "last_n_days", days=2), "v") == [1]
    with pytest.raises(ValueError):
        rm.filter_relative_dates(df, "d", "today", days=1)
    with pytest.raises(ValueError):
        rm.filter_relative_dates(df, "d", "last_n_days")


def test_relative_date_range_reaches_the_scan(spark, tmp_path, table):
    path = str(tmp_path / "t")
    table("d timestamp_ntz, v int", (TODAY, 1)).write.parquet(path)
    out = rm.filter_relative_dates(spark.read.parquet(path), "d", "this_month", today=TODAY)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d," in plan and "LessThan(d," in plan


@pytest.mark.parametrize("options, first, last", [
    ({}, (1, 1), (12, 31)), ({"half": 1}, (1, 1), (6, 30)), ({"half": 2}, (7, 1), (12, 31)), ({"quarter": 3}, (7, 1), (9, 30)),
    ({"quarter": 4}, (10, 1), (12, 31)),
])
def test_calendar_period_includes_its_last_day(table, options, first, last):
    start, end = dt.datetime(2025, *first), dt.datetime(2025, *last, 23, 59, 59)
    moments = [start - dt.timedelta(seconds=1), start, end, end + dt.timedelta(seconds=1)]
    df = table("d timestamp_ntz, v int", *[(m, i) for i, m in enumerate(moments)])
    assert sorted(values(rm.filter_calendar_period(df, "d", 2025, **options), "v")) == [1, 2]
