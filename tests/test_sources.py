import datetime as dt
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import rowmill as rm
from tests.conftest import rows, values


def test_csv_headers_blank_rows_and_positions(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" name ,amount\nx,1\n, \ny,2\n")
    df = rm.load_table(spark, str(tmp_path / "a.csv"), "csv", include_source_metadata=True)
    assert df.columns[:2] == ["name", "amount"]
    assert values(df, "name", order="_source_row") == ["x", "y"]
    total = rm.cumulative_sum(df, "amount")
    assert sorted(values(total, "running_total")) == [1.0, 3.0]


def test_parquet_positions_give_row_order(spark, tmp_path, table):
    table("k string, n int", *[("k", i) for i in range(20)]).coalesce(1).write.parquet(str(tmp_path / "p"))
    df = rm.load_table(spark, str(tmp_path / "p"), include_source_metadata=True)
    assert values(rm.remove_duplicates(df, "k"), "n") == [0]
    assert values(rm.remove_duplicates(df, "k", "last"), "n") == [19]


def test_hidden_rows(spark, tmp_path, table):
    table("n int, hide boolean", (1, True), (2, None)).write.parquet(str(tmp_path / "p"))
    df = rm.load_table(spark, str(tmp_path / "p"), hidden_column="hide")
    assert df.count() == 2 and values(rm.select_visible_rows(df), "n") == [2]
    assert rm.load_table(spark, str(tmp_path / "p"), hidden_column="hide", include_hidden_rows=False).count() == 1


@pytest.mark.parametrize("format", ["csv", "json", "orc", "parquet"])
def test_written_results_read_back(spark, tmp_path, table, format):
    df = table("d timestamp_ntz, n bigint, _hidden boolean", (dt.datetime(2026, 1, 1), 1, False))
    rm.write_result(df, str(tmp_path / "out"), format)
    back = rm.load_table(spark, str(tmp_path / "out"), format)
    assert sorted(back.columns) == ["d", "n"]
    if format in ("csv", "json"):
        assert values(back, "d") == ["2026-01-01"]
    with pytest.raises(PySparkException):
        rm.write_result(df, str(tmp_path / "out"), format)


def test_sources_are_not_overwritten(tmp_path, table):
    df = table("n int", (1,))
    source = str(tmp_path / "in")
    for target in (source, source + "/", "file://" + source, source + "/part", str(tmp_path / "x" / ".." / "in")):
        with pytest.raises(ValueError, match="overwrite"):
            rm.write_result(df, target, source_paths=[source])
    rm.write_result(df, source + "2", source_paths=source)


def test_combined_tables(table):
    a = table("date string, company string, amount int", ("2026-01-01", "A", 1))
    b = table("company string, amount string, fee int", ("B", "x", 3))
    df = rm.combine_tables({"jan": a, "feb": b})
    assert df.columns == ["source_table", "date", "company", "amount", "fee"]
    assert sorted(rows(df)) == [("feb", None, "B", "x", 3), ("jan", "2026-01-01", "A", "1", None)]
    with pytest.raises(ValueError, match="origin"):
        rm.combine_tables({"x": df})


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_combined_files(spark, tmp_path, format):
    import pandas as pd

    frames = {"jan 1": pd.DataFrame({"company": ["A"], "amount": [1]}), "feb": pd.DataFrame({"amount": [2], "company": ["B"], "fee": [3]})}
    paths = []
    for name, frame in frames.items():
        paths.append(str(tmp_path / f"{name}.{format}"))
        frame.to_parquet(paths[-1]) if format == "parquet" else frame.to_csv(paths[-1], index=False)
    df = rm.combine_files(spark, paths, format)
    assert df.columns[:2] == ["source_file", "source_table"]
    got = [tuple(None if v is None else str(v) for v in r) for r in rows(df, "source_file", "source_table", "company", "amount", "fee")]
    assert sorted(got) == [(f"feb.{format}", "feb", "B", "2", "3"), (f"jan 1.{format}", "jan 1", "A", "1", None)]
    placed = rm.combine_files(spark, paths, format, include_source_metadata=True)
    assert rm.cumulative_sum(placed, "amount").count() == 2


def test_column_aliases():
    mine = ["#", "Date rcvd", "Type", "CO", "Amount"]
    assert rm.infer_column_aliases(mine, [["#", "date RCVD", "Type", "COMPANY", "Amount"]]) == {"CO": ["COMPANY"]}
    assert rm.infer_column_aliases(mine, [["no", "month", "dept", "COMPANY", "sum"]]) == {}
    assert rm.infer_column_aliases(["a", "CO"], [["a", "b", "c"]]) == {}
    assert rm.infer_column_aliases(mine, [["#", "Date rcvd", "Type", "amount", "CO"]]) == {}


def test_run_log_appends(spark, tmp_path):
    for status in ("done", "failed"):
        rm.append_run_log(spark, str(tmp_path / "log"), status, [{"function": "x", "params": {}}], error=None)
    log = spark.read.json(str(tmp_path / "log"))
    assert sorted(values(log, "status")) == ["done", "failed"]
    assert json.loads(log.first().steps) == [{"function": "x", "params": {}}]


def grid(table, *lines, file="f", sheet="s"):
    cells = [
        (file, sheet, r, c, v) for r, line in enumerate(lines, start=1) for c, v in enumerate(line, start=1) if v is not None
    ]
    return table("file string, sheet string, row int, col int, value string", *cells)


def test_region_below_a_title(table):
    cells = grid(table, ["[Table 1]"], ["client", "paid", "day"], ["A", "100000", "2026-01-01"], ["B", "200000", "2026-01-02"])
    regions = rm.find_table_regions(cells)
    assert rows(regions, "header_row", "start_col", "end_col", "data_start_row", "data_end_row", "headers", "filled_rows") == [
        (2, 1, 3, 3, 4, ["client", "paid", "day"], 2)
    ]
    assert rows(rm.read_region(cells, regions, ["client", "paid", "day"]), "client", "paid", order="_source_row") == [
        ("A", "100000"), ("B", "200000"),
    ]


def test_declared_region_wins(table):
    cells = grid(
        table, ["day", "company", "amount"], ["2026-01-01", "A", "100"], ["2026-01-02", "B", "200"], ["sum", None, "300"], [],
        ["HOLD", "looks like a title"], ["VALUE", "next row"],
    )
    declared = table(
        "file string, sheet string, header_row int, start_col int, end_col int, end_row int, has_totals boolean",
        ("f", "s", 1, 1, 3, 4, True), ("f", "s", 6, 1, 2, 7, False),
    )
    found = rm.find_table_regions(cells, declared)
    assert rows(found, "header_row", "data_end_row", "confidence", "filled_rows") == [(1, 3, 1.0, 2)]


def test_region_ends_at_two_blank_rows_and_repeats_are_numbered(table):
    body = [[f"n{i}", str(i)] for i in range(250)]
    cells = grid(table, [None, "x"], [], ["name", "name"], *body[:240], [], *body[240:], [], [], ["far", "away"], ["a", "b"])
    found = rm.find_table_regions(cells)
    assert rows(found, "header_row", "data_end_row", "headers", "filled_rows") == [(3, 254, ["name", "name_2"], 250)]


def test_one_region_per_sheet_and_none_for_an_empty_one(table):
    a = grid(table, ["k", "v"], ["a", "1"], sheet="one")
    b = grid(table, ["lonely"], sheet="two")
    c = grid(table, ["k", "v"], ["z", "9"], ["y", "8"], sheet="three")
    found = rm.find_table_regions(a.union(b).union(c))
    assert sorted(values(found, "sheet")) == ["one", "three"]
    assert rm.read_region(a.union(b).union(c), found, ["k", "v"]).count() == 3


@pytest.mark.parametrize("size", [1000, 3])
def test_cells_of_csv_grids(spark, tmp_path, size):
    (tmp_path / "my grid.csv").write_text('[Title]\n\nclient,note,paid\nA,"x, y",1\nB,,2\n' + "".join(f"C{i},n,{i}\n" for i in range(30)))
    cells = rm.cells_from_csv(spark, str(tmp_path / "my grid.csv"), width=5, rows_per_task=size)
    regions = rm.find_table_regions(cells)
    assert rows(regions, "sheet", "header_row", "data_end_row", "headers") == [("my grid", 3, 35, ["client", "note", "paid"])]
    table = rm.read_region(cells, regions, ["client", "note", "paid"])
    assert rows(table, "client", "note", "paid", order="_source_row")[:2] == [("A", "x, y", "1"), ("B", None, "2")]


def test_types_of_text_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("whole,num,mixed,code,day,moment,flag,text,empty\n1,1.5,1,007,2026-01-02,2026-01-02 03:04:05,true,x,\n"
                                    " -2 ,1e3,2.5,012,2026-02-03,2026-02-03,False,1,\n,,,,,,,,\n3,+4,3,5,2026/03/04,2026-03-04,TRUE,2, \n")
    df = rm.load_table(spark, str(tmp_path / "a.csv"), "csv", infer_types=True)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "double", "string", "date", "timestamp_ntz", "boolean", "string", "string"]
    assert rows(df, "whole", "num", "mixed", "code", "flag", "text", order="whole") == [
        (-2, 1000.0, 2.5, "012", False, "1"), (1, 1.5, 1.0, "007", True, "x"), (3, 4.0, 3.0, "5", True, "2"),
    ]
    assert rows(rm.group_sum(df, "flag", "whole"), order="flag") == [(False, -2), (True, 4)]
    plain = rm.load_table(spark, str(tmp_path / "a.csv"), "csv")
    assert {f.dataType.simpleString() for f in plain.schema.fields} == {"string"}
    (tmp_path / "b.csv").write_text("x,y\n")
    assert rm.load_table(spark, str(tmp_path / "b.csv"), "csv", infer_types=True).count() == 0


def test_files_of_clashing_kinds(spark, tmp_path):
    spark.createDataFrame([(1, 5)], "k int, v int").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, "x")], "k bigint, v string").write.parquet(str(tmp_path / "b"))
    spark.createDataFrame([(3, "y", True)], "k bigint, v string, hide boolean").write.parquet(str(tmp_path / "c"))
    paths = [str(tmp_path / n) for n in "abc"]
    df = rm.combine_files(spark, paths, hidden_column="hide")
    assert rows(df, "source_file", "k", "v", "_hidden", order="k") == [("a", 1, "5", None), ("b", 2, "x", None), ("c", 3, "y", True)]
    assert df.schema["k"].dataType.simpleString() == "bigint"
    shown = rm.combine_files(spark, paths, hidden_column="hide", include_hidden_rows=False, include_source_metadata=True)
    assert shown.count() == 2 and {"_source_file", "_source_row"} <= set(shown.columns)


def test_many_text_files_are_a_scan_per_layout(spark, tmp_path):
    for i in range(12):
        head, line = ("a,b", f"{i},x{i}") if i % 2 else ("b, a ,c", f"x{i},{i},")
        (tmp_path / f"f {i}+.csv").write_text(f"{head}\n{line}\n , \n")
    (tmp_path / "more").mkdir()
    for i in (20, 21):
        (tmp_path / "more" / f"part-{i}.csv").write_text(f"a,b\n{i},x{i}\n")
    paths = [str(p) for p in sorted(tmp_path.glob("f*"))] + [str(tmp_path / "more")]
    df = rm.combine_files(spark, paths, "csv", infer_types=True)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
    found = rows(df, "source_file", "source_table", "a", "b", order="a")
    assert found == [(f"f {i}+.csv", f"f {i}+", i, f"x{i}") for i in range(12)] + [("more", "more", i, f"x{i}") for i in (20, 21)]
    placed = rm.combine_files(spark, paths, "csv", include_source_metadata=True)
    assert len({r[0] for r in rows(placed, "_source_file")}) == 14


TRICKY = [
    ['a', 'b', 'c'], ['1', 'line one\nline two', 'x'], ['2', 'quote " inside\n\n"twice", with, commas', 'y'], ['3', '5" pipe', '6"'], ['4', '', ' "'], ['', 'only\nthis', ''],
    ['7', '\n', 'z'], ['8', 'a\nb\nc\nd,"e"\nf', 'end'], ['9', 'x', 'y'],
]


@pytest.mark.parametrize("size", [10**6, 3])
@pytest.mark.parametrize("options, between, repeats", [({"escape": '"'}, ",", 1), ({"escape": '"', "sep": ";"}, ";", 40), ({"escape": '"', "quote": "'"}, "|", 3)])
def test_line_breaks_inside_quoted_cells(spark, tmp_path, size, options, between, repeats):
    import csv

    quote, options = options.get("quote", '"'), {**options, "delimiter": between}
    if quote != '"':
        options["escape"] = quote
    table = [[c.replace('"', quote) for c in row] for row in TRICKY] * repeats
    with open(tmp_path / "grid.csv", "w", newline="") as file:
        csv.writer(file, delimiter=between, quotechar=quote, lineterminator="\n").writerows(table)
    with open(tmp_path / "other.csv", "w", newline="") as file:
        csv.writer(file, delimiter=between, quotechar=quote, lineterminator="\n").writerows(table[::-1])
    options.pop("sep", None)
    cells = rm.cells_from_csv(spark, str(tmp_path), rows_per_task=size, **options)
    for name, rows_of in (("grid", table), ("other", table[::-1])):
        expected = {(r, c, v) for r, row in enumerate(rows_of, 1) for c, v in enumerate(row, 1) if v.strip()}
        assert {(x["row"], x["col"], x["value"]) for x in cells.where(F.col("sheet") == name).collect()} == expected


def test_stray_quotes_join_no_lines(spark, tmp_path):
    """Quotes that open no cell: inside or behind a word; and a backslash that keeps a quote from closing."""
    (tmp_path / "g.csv").write_text('size,what\n5",pipe\n6" wide,plank "old"\n"a \\" b",c\n"x\ny",z\n')
    cells = rm.cells_from_csv(spark, str(tmp_path / "g.csv"))
    found = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert found == {(1, 1): "size", (1, 2): "what", (2, 1): '5"', (2, 2): "pipe", (3, 1): '6" wide', (3, 2): 'plank "old"',
                     (4, 1): 'a " b', (4, 2): "c", (5, 1): "x\ny", (5, 2): "z"}
