import datetime as dt

import pytest
from pyspark.errors import PySparkException

import rowmill as rm
from tests.conftest import rows, values


@pytest.fixture
def ledger(table):
    return table(
        "CO string, COMPANY string, amount_text string, note string",
        (" A  Corp ", None, "100", None), (None, "B-Corp", "200", " ok\ntext "), ("", None, None, None),
    )


def test_rename_clean_fill_and_convert(ledger):
    df = rm.normalize_column_names(ledger, {"CO": "COMPANY"})
    df = rm.drop_rows_missing_keys(df, "COMPANY", require="any")
    df = rm.normalize_text(df, ["COMPANY", "note"])
    df = rm.fill_missing_values(df, {"note": "none"})
    df = rm.convert_column_type(df, "amount_text", "number", errors="coerce")
    df = rm.reorder_columns(df, ["COMPANY", "amount_text"], keep_remaining=True)
    assert df.columns == ["COMPANY", "amount_text", "note"]
    assert rows(df, order="amount_text") == [("A Corp", 100.0, "none"), ("B-Corp", 200.0, "ok text")]
    assert rm.select_columns(df, ["COMPANY"]).columns == ["COMPANY"]


def test_rename_keeps_blank_text_in_the_new_column(table):
    df = rm.normalize_column_names(table("a string, b string", ("x", ""), ("y", None)), {"a": "b"})
    assert sorted(values(df, "b")) == ["", "y"]


def test_column_names_with_dots_and_backticks(table):
    df = table("`a.b` bigint, `c d` string, `e``f` string", (1, "x", "y"))
    assert rm.select_columns(df, ["e`f", "a.b"]).columns == ["e`f", "a.b"]
    assert values(rm.filter_rows(df, "a.b", ">=", 1), "c d") == ["x"]


def test_drop_columns_refuses_none_and_all(table):
    df = table("customer string, memo string, amount bigint", ("A", "m", 1))
    assert rm.drop_columns(df, ["memo"]).columns == ["customer", "amount"]
    with pytest.raises(ValueError):
        rm.drop_columns(df, [])
    with pytest.raises(ValueError):
        rm.drop_columns(df, ["customer", "memo", "amount"])
    with pytest.raises(KeyError):
        rm.drop_columns(df, ["absent"])


@pytest.mark.parametrize("word, expected", [
    (" TRUE ", True), ("1", True), ("예", True), ("참", True), ("No", False), ("0", False), ("거짓", False), (None, None),
])
def test_boolean_words(table, word, expected):
    df = rm.convert_column_type(table("w string", (word,)), "w", "boolean")
    assert values(df, "w") == [expected]


def test_conversion_errors_raise_or_coerce(table):
    df = table("w string", ("maybe",))
    assert values(rm.convert_column_type(df, "w", "boolean", errors="coerce"), "w") == [None]
    for target in ("boolean", "number", "datetime"):
        with pytest.raises(PySparkException, match="column w"):
            rm.convert_column_type(df, "w", target).collect()


@pytest.mark.parametrize("text, expected", [
    ("1e3", 1000.0), (" 2 ", 2.0), (".5", 0.5), ("-7", -7.0), ("inf", float("inf")),
    ("", None), ("True", None), ("1_0", None), ("1d", None), ("NaN", None), ("1,000", None),
])
def test_numbers_from_text(table, text, expected):
    assert values(rm.convert_column_type(table("w string", (text,)), "w", "number", errors="coerce"), "w") == [expected]


@pytest.mark.parametrize("text, expected", [
    ("2024-01-05", dt.datetime(2024, 1, 5)), ("2024/1/5", dt.datetime(2024, 1, 5)), ("20240105", dt.datetime(2024, 1, 5)),
    ("2024.01.05", dt.datetime(2024, 1, 5)), ("1/5/2024", dt.datetime(2024, 1, 5)),
    ("2024-01-05 10:11:12", dt.datetime(2024, 1, 5, 10, 11, 12)), ("now", None), ("today", None), ("x", None), ("2024-13-01", None),
])
def test_dates_from_text(table, text, expected):
    assert values(rm.convert_column_type(table("w string", (text,)), "w", "datetime", errors="coerce"), "w") == [expected]


def test_date_format_and_day(table):
    df = table("w string", ("05.01.2024 13:45",))
    out = rm.convert_column_type(df, "w", "datetime", date_format="%d.%m.%Y %H:%M")
    assert values(out, "w") == [dt.datetime(2024, 1, 5, 13, 45)]
    out = rm.convert_column_type(df, "w", "date", date_format="%d.%m.%Y %H:%M")
    assert values(out, "w") == [dt.datetime(2024, 1, 5)]


@pytest.mark.parametrize("number", [
    0.0, 100.0, 0.1, 1e7, 12345678.9, 1e15, 123456789012345.6, 1e16, 1.5e300, 1e-3, 1.234e-4, 1e-4, 1e-5, 2.5e-7, -12345678.9,
    -1.5e-5, 1e100, 99999999.99,
])
def test_text_of_doubles_is_shortest_decimal(table, number):
    assert values(rm.convert_column_type(table("x double", (number,)), "x", "string"), "x") == [repr(number)]


def test_text_of_other_types(table):
    df = table("b boolean, t timestamp_ntz, n bigint", (True, dt.datetime(2024, 1, 1), 5), (False, dt.datetime(2024, 1, 1, 3, 4, 5), 6))
    for name in df.columns:
        df = rm.convert_column_type(df, name, "string")
    assert sorted(rows(df)) == [("False", "2024-01-01 03:04:05", "6"), ("True", "2024-01-01", "5")]


def test_empty_rows(table):
    df = table("a double, b string", (None, None), (float("nan"), None), (1.0, None), (2.0, ""))
    assert df.transform(rm.remove_empty_rows).count() == 2
    assert values(rm.remove_empty_rows(df, how="any"), "a") == [2.0]


def test_missing_keys_any_and_all(table):
    df = table("a string, b string, n bigint", ("x", " ", 1), (" ", None, 2), ("x", "y", 3))
    assert sorted(values(rm.drop_rows_missing_keys(df, ["a", "b"]), "n")) == [1, 3]
    assert values(rm.drop_rows_missing_keys(df, ["a", "b"], require="all"), "n") == [3]


def test_fill_checks_types_and_widens(table):
    df = table("n int, d double, s string", (None, float("nan"), None), (1, 2.0, ""))
    out = rm.fill_missing_values(df, {"n": 0.5, "d": 3, "s": "-"})
    assert sorted(rows(out)) == [(0.5, 3.0, "-"), (1.0, 2.0, "")]
    with pytest.raises(TypeError):
        rm.fill_missing_values(df, {"n": "text"})
    with pytest.raises(KeyError):
        rm.fill_missing_values(df, {"absent": 1})


@pytest.mark.parametrize("keep, expected", [("first", [1, 3, 4]), ("last", [2, 3, 5]), (False, [3])])
def test_duplicates(table, keep, expected):
    df = table("k string, n bigint", ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5))
    assert sorted(values(rm.remove_duplicates(df, ["k"], keep, order_columns="n"), "n")) == expected
    marked = rm.mark_duplicates(df, ["k"], keep=keep, order_columns="n")
    assert sorted(values(marked.filter("not is_duplicate"), "n")) == expected


def test_whole_row_duplicates(table):
    df = table("k string, n bigint", ("a", 1), ("a", 1), ("b", 1), (None, None), (None, None))
    assert rm.remove_duplicates(df).count() == 3
    assert rm.remove_duplicates(df, keep=False).count() == 1
    assert rm.mark_duplicates(df).filter("is_duplicate").count() == 4
    assert rm.mark_duplicates(df, keep="first").filter("is_duplicate").count() == 2


def test_row_order_has_to_be_known(table):
    df = table("k string, n bigint", ("a", 1))
    for call in (
        lambda: rm.remove_duplicates(df, ["k"]), lambda: rm.cumulative_sum(df, "n"), lambda: rm.percent_change(df, "n"),
        lambda: rm.rank_rows(df, "n", method="first"), lambda: rm.keep_latest_per_group(df, "k", "k"),
    ):
        with pytest.raises(ValueError, match="row order"):
            call()


def test_visible_rows(table):
    df = table("n bigint, _hidden boolean", (1, False), (2, True), (3, None))
    assert sorted(values(rm.select_visible_rows(df), "n")) == [1, 3]
    with pytest.raises(KeyError):
        rm.select_visible_rows(df.drop("_hidden"))


def test_quality_marks(table):
    df = table(
        "txn bigint, company string, booked double, computed double, status string",
        (1, "A", 100.0, 100.0, "ok"), (1, "A", 100.0, 99.5, " #VALUE! "), (2, "B", 50.0, 40.0, None),
    )
    df = rm.mark_error_values(df, "status")
    df = rm.mark_missing_required(df, ["company", "status"])
    df = rm.compare_columns(df, "booked", "computed", tolerance=1)
    got = rows(df, "has_error", "error_detail", "is_missing_required", "missing_columns", "matches", order="computed")
    assert got == [
        (False, "", True, "status", False), (True, "status= #VALUE! ", False, "", True), (False, "", False, "", True),
    ]
    assert rm.mark_error_values(df.drop("has_error", "error_detail")).filter("has_error").count() == 1
