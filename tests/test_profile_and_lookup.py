import datetime as dt

import pytest

from pyspark.sql import functions as F

import rowmill as rm
from tests.conftest import rows


@pytest.mark.parametrize("size", [1000, 2])
def test_profile(table, size):
    df = table(
        "i int, amount double, date timestamp_ntz, kind string, numtext string",
        (1, 10.0, dt.datetime(2026, 1, 1), "a", "1"), (2, None, dt.datetime(2026, 3, 1), "b", "x"),
        (3, -5.0, None, "a", "2026-01-01"), (4, 0.0, dt.datetime(2026, 2, 1), "a", None),
    )
    found = {r["column"]: r for r in rm.profile_table(df, order_columns="i", rows_per_task=size).collect()}
    amount, date, kind, mixed = (found[n] for n in ("amount", "date", "kind", "numtext"))
    assert (amount.row_count, amount.missing_count, amount.unique_count) == (4, 1, 3)
    assert (amount["min"], amount["max"], amount["sum"], amount["median"], amount.zero_count, amount.negative_count) == (-5, 10, 5, 0, 1, 1)
    assert amount["mean"] == pytest.approx(5 / 3) and amount.sample_values == ["10.0", "-5.0", "0.0"]
    assert (date.min_date, date.max_date, date.missing_count) == ("2026-01-01", "2026-03-01", 1)
    assert (kind.unique_count, kind.unique_ratio, kind.average_length) == (2, 0.5, 1.0)
    assert kind.sample_values == ["a", "b"] and [(t.value, t["count"]) for t in kind.top_values] == [("a", 3), ("b", 1)]
    assert (mixed.numeric_parse_ratio, mixed.datetime_parse_ratio) == (0.3333, 0.3333)


def test_profile_of_identifiers_and_of_empty_columns(table):
    df = table("id string, empty string", *[(f"id{i:03}", None) for i in range(30)])
    found = {r["column"]: r for r in rm.profile_table(df).collect()}
    assert found["id"].top_values is None and found["id"].sample_values == ["id000", "id001", "id002"]
    assert found["empty"].missing_count == 30 and found["empty"].unique_count == 0
    assert found["empty"].sample_values == [] and found["empty"].unique_ratio is None


@pytest.fixture
def shops(table):
    return table(
        "store string, item string, qty int", ("North", "blue pen", 1), ("North", "pen", 2), ("South", "pad", 3),
        (" South ", "pen", 4), (None, "pen.", 5),
    )


def test_find_values_matches_whole_words(shops):
    assert rows(rm.find_values(shops, "How many PEN in south?")) == [("store", "South", 2), ("item", "pen", 2)]
    assert rows(rm.find_values(shops, "pencils in the northern shop")) == []
    assert ("item", "pen.", 1) in rows(rm.find_values(shops, "a pen. please"))
    assert rows(rm.find_values(shops, "pen", max_distinct=3)) == []


def test_columns_of_many_values_are_left_out_if_asked_for(table):
    df = table("s string, few string", *[(f"w{i}", "w1") for i in range(300)])
    assert rows(rm.find_values(df, "w1 w2", max_distinct=100)) == [("few", "w1", 300)]
    assert rows(rm.find_values(df, "w1 w2")) == [("few", "w1", 300), ("s", "w1", 1), ("s", "w2", 1)]


def test_filter_candidates_from_fragments(shops):
    out = rm.find_filter_candidates(shops, fragments=["pen", "Zzz"], columns=["item"])
    assert rows(out, "operator", "value", "row_count") == [
        ("==", "pen", 2), ("contains", "pen", 4), ("startswith", "pen", 3), ("endswith", "pen", 3),
    ]
    assert out.filter("operator = 'contains'").first().matched_values == ["blue pen", "pen", "pen."]


def test_filter_candidates_list_equal_row_sets_once(table):
    df = table("vendor string", ("Acme Ltd",), ("Acme Inc",), ("Other",))
    assert rows(rm.find_filter_candidates(df, fragments=["acme"]), "operator", "row_count") == [("contains", 2)]


def test_filter_candidates_from_text(table):
    df = table("vendor string", ("Acme Ltd",), ("Acme Inc",), ("Other",))
    got = rows(rm.find_filter_candidates(df, text="rows of acme please"), "operator", "value", "row_count")
    assert got[0] == ("contains", "Acme ", 2)  # as the column spells it


def test_values_are_matched_after_they_are_counted(spark, tmp_path):
    """No test of the search text stands below the count of distinct values, and long texts are left out before it."""
    spark.range(50).selectExpr("concat('item-', id % 5) AS item", "repeat('long text ', 400) AS note").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    out = rm.find_values(df, "show item-3 and item-4")
    assert rows(out) == [("item", "item-3", 10), ("item", "item-4", 10)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" in plan[: plan.rindex("Aggregate")] and "Contains(" not in plan[plan.rindex("Aggregate"):]
    assert rows(rm.find_values(spark.createDataFrame([("F",), ("O",), ("  F  " + " " * 200,)], "s string"), "only f")) == [("s", "F", 2)]


def test_shared_pieces_against_brute_force(spark):
    import random

    from rowmill.operators.lookup import _shared_pieces

    rng = random.Random(8)
    for text in ("abacabadab", "b", "", "ab" * 200):
        values = ["", "b", "abab", text, *["".join(rng.choices("abcd", k=rng.randint(1, 30))) for _ in range(40)]]
        df = spark.createDataFrame([(v,) for v in values], "v string")
        for v, found in df.select("v", _shared_pieces(F.col("v"), text, 2).alias("p")).collect():
            pieces = {text[i:j] for i in range(len(text)) for j in range(i + 2, min(len(text), i + len(v)) + 1) if text[i:j] in v} if len(v) > 1 else set()
            best = max(map(len, pieces), default=0)
            assert sorted(found) == sorted(p for p in pieces if len(p) == best)
