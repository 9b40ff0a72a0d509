"""Results must not depend on how many rows, columns, values or copies there are."""

import pytest
from pyspark.sql import functions as F

import rowmill as rm
from rowmill.operators import sorting
from rowmill.sources.load import clean_headers
from tests.conftest import rows


@pytest.mark.parametrize("size", [100, 10**6])
def test_long_top_lists(spark, monkeypatch, size):
    monkeypatch.setattr(sorting, "SHORT_LIST", 10)
    df = spark.range(3000).select((F.col("id") * 7919 % 3000 % 500).alias("v"), F.col("id").alias("id"))
    expected = sorted(((r.v, r.id) for r in df.collect()), key=lambda r: (-r[0], r[1]))[:1500]
    assert [tuple(r) for r in rm.select_top_n(df, "v", 1500, order_columns="id", rows_per_task=size).collect()] == expected
    assert rm.select_top_n(df, "v", 200_000).count() == 3000


def test_long_replacement_maps_convert_like_short_ones(table):
    df = table("v double, flag boolean, n int", (1.0, True, 1), (2.0, None, None), (99.0, False, 60))
    for extra in (0, 100):
        more = {1000 + i: i for i in range(extra)}
        assert rows(rm.replace_values(df, "v", {1: 10, 2: 20, **more}), "v") == [(10.0,), (20.0,), (99.0,)]
        assert rows(rm.replace_values(df, "n", {True: 7, None: 5, **more}), "n") == [(7,), (5,), (60,)]


def test_profiles_cover_every_type(table):
    df = table("a array<int>, b binary, m map<string,int>, s struct<x:int>", ([1, 2], b"\x01", {"k": 1}, (1,)), ([1, 2], None, None, (2,)))
    found = {r["column"]: r for r in rm.profile_table(df).collect()}
    assert {n: r["type"] for n, r in found.items()} == {"a": "array<int>", "b": "binary", "m": "map<string,int>", "s": "struct<x:int>"}
    assert found["a"]["unique_count"] == 1 and found["b"]["missing_count"] == 1 and found["b"]["sample_values"] == ["01"]


def test_wide_grids_with_late_headers(spark, tmp_path):
    lines = [f"note {i}" for i in range(250)] + [",".join(f"name{c}" for c in range(120))] + [",".join(str(r * c) for c in range(120)) for r in range(1, 8)]
    (tmp_path / "grid.csv").write_text("\n".join(lines))
    cells = rm.cells_from_csv(spark, str(tmp_path / "grid.csv"))
    assert cells.agg(F.max("col")).first()[0] == 120
    region = rm.find_table_regions(cells, header_rows=300).first()
    assert (region["header_row"], region["end_col"], len(region["headers"]), region["filled_rows"]) == (251, 120, 120, 7)
    assert rm.read_region(cells, rm.find_table_regions(cells, header_rows=300), region["headers"]).count() == 7


@pytest.mark.parametrize("options, between", [
    ({"delimiter": ";"}, ";"), ({"DELIMITER": ";"}, ";"), ({"Sep": ";", "delimiter": ","}, ";"), ({"sep": "\\t"}, "\t"), ({"delimiter": "||"}, "||"), ({}, ","),
])
def test_every_separator_counts_for_the_width(spark, tmp_path, options, between):
    (tmp_path / "grid.csv").write_text("\n".join([between.join("abc"), between.join(["1", "", "3", "4"])]))
    cells = rm.cells_from_csv(spark, str(tmp_path / "grid.csv"), **options)
    assert sorted((r["row"], r["col"], r["value"]) for r in cells.collect()) == [
        (1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "1"), (2, 3, "3"), (2, 4, "4")
    ]


@pytest.mark.parametrize("block, leads", [(4096, 4), (7, 1)])
def test_tables_below_many_rows_of_text(spark, monkeypatch, block, leads):
    """A late and larger table, with words in its rows, wins over the first; gaps of one row stay inside, blocks and spans change nothing."""
    from rowmill.sources import regions

    monkeypatch.setattr(regions, "ROW_BLOCK", block)
    monkeypatch.setattr(regions, "LEADING_SPANS", leads)
    lines = {1: ["k", "v", "w", "x", "y"], 2: ["a", "b", "c", "d", "e"], 3: ["f", "g", "h", "i", "j"], 400: ["name", "town", "size"]}
    lines |= {r: [f"n{r}", f"t{r}" if r % 3 else None, str(r)] for r in range(401, 460) if r != 430}
    cells = [("f", "s", r, c, v) for r, line in lines.items() for c, v in enumerate(line, 1) if v is not None]
    df = spark.createDataFrame(cells, "file string, sheet string, row int, col int, value string")
    found = rm.find_table_regions(df).collect()
    assert [(r["header_row"], r["start_col"], r["end_col"], r["data_end_row"], r["filled_rows"], r["headers"]) for r in found] == [
        (400, 1, 3, 459, 58, ["name", "town", "size"])
    ]
    assert rm.read_region(df, rm.find_table_regions(df), ["name", "town", "size"]).count() == 58
    assert [r["header_row"] for r in rm.find_table_regions(df, header_rows=200).collect()] == [1]


@pytest.mark.parametrize("names, expected", [
    (["a", "a_2", "a"], ["a", "a_2", "a_3"]), ([" a ", "", "a", "a"], ["a", "column_2", "a_2", "a_3"]), (["a", "a", "a_2"], ["a", "a_3", "a_2"]), ([], []),
])
def test_header_names_are_unique(spark, names, expected):
    assert clean_headers(names) == expected
    cells = spark.createDataFrame([("f", "s", 1, i + 1, n) for i, n in enumerate(names)] or [("f", "s", 1, 1, "x")], "file string, sheet string, row int, col int, value string")
    from rowmill.sources.regions import _unique_names

    if names:
        assert cells.select(_unique_names(F.array(*[F.lit(n) for n in names]), F.lit(1)).alias("n")).first()["n"] == expected


def test_whole_rows_leave_out_where_they_come_from(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "n int, s string").coalesce(1).write.parquet(path)
    df = rm.load_table(spark, path, include_source_metadata=True)
    assert rm.remove_empty_rows(df).count() == 3
    assert [r["_source_row"] for r in rm.remove_duplicates(df).orderBy("_source_row").collect()] == [1, 3, 4]
    assert [r["_source_row"] for r in rm.remove_duplicates(df, keep="last").orderBy("_source_row").collect()] == [2, 3, 4]
    assert sorted(r["n"] or 0 for r in rm.remove_duplicates(df, keep=False).collect()) == [0, 2]
    assert rm.mark_duplicates(df, result_column="d").filter("d").count() == 2
    assert [r["_source_row"] for r in rm.mark_duplicates(df, result_column="d", keep="first").filter("d").collect()] == [2]


@pytest.mark.parametrize("keep", ["first", "last"])
def test_one_row_repeated_many_times_is_marked_in_ranges(spark, keep):
    df = spark.range(4000).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    assert rm.mark_duplicates(df, result_column="d", keep=keep, rows_per_task=500).filter("d").count() == 3999


def test_only_repeats_that_change_nothing_are_dropped():
    squeeze = {"function": "replace_text", "params": {"column": "c", "old": "aa", "new": "a"}}
    fill = {"function": "fill_missing_values", "params": {"values": {"c": "x"}}}
    assert rm.normalize_steps([squeeze, squeeze, fill, fill, squeeze]) == [squeeze, squeeze, fill, squeeze]


def test_files_of_a_partitioned_folder_keep_its_name(spark, tmp_path):
    for part in ("2023", "2024"):
        spark.createDataFrame([(1,)], "n int").write.parquet(str(tmp_path / "my table+1" / f"dt={part}"))
    found = rm.combine_files(spark, [str(tmp_path / "my table+1")])
    assert {r["source_file"] for r in found.collect()} == {"my table+1"} and found.count() == 2


def test_parts_of_a_request_are_found_whatever_the_number_of_values(spark):
    df = spark.range(500).select(F.concat(F.lit("Item-"), F.col("id").cast("string")).alias("item"), F.lit("x" * 200).alias("long"))
    assert rows(rm.find_values(df, "show item-77 and item-12")) == [("item", "Item-12", 1), ("item", "Item-77", 1)]
    best = rm.find_filter_candidates(df, text="of item-49 only", columns=["item"]).collect()
    assert ("contains", "Item-49", 11) in {(r["operator"], r["value"], r["row_count"]) for r in best}
    for r in best:
        assert rm.filter_rows(df, "item", r["operator"], r["value"]).count() == r["row_count"]
        assert len(r["matched_values"]) <= 8
