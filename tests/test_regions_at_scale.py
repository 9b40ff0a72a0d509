"""Grids whose cells are many more than the optimizer expects: no table of cells or sheet rows is broadcast or grouped in one task."""

import pytest
from pyspark.sql import functions as F

import rowmill as rm
from tests.conftest import rows


def exploded(spark, lines=40, width=12):
    """A grid exploded from few rows, so that its estimated size is far too small."""
    place = [F.lit("f").alias("file"), F.lit("s").alias("sheet"), (F.col("id") + 1).alias("row")]
    values = F.array(*[F.when(F.col("id") == 0, f"h{i}").otherwise((F.col("id") * i).cast("string")) for i in range(1, width + 1)])
    cells = spark.range(lines).select(*place, F.posexplode(values))
    return cells.select("file", "sheet", "row", (F.col("pos") + 1).alias("col"), F.col("col").alias("value"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_are_not_broadcast_for_the_header_names(spark):
    found = rm.find_table_regions(exploded(spark))
    assert "LeftOuter, BuildRight" not in plan(found)  # the heads are the right side
    assert rows(found, "header_row", "end_col", "data_end_row", "filled_rows") == [(1, 12, 40, 39)]


def test_regions_do_not_depend_on_tasks_or_joins(spark, monkeypatch):
    from rowmill.sources import regions

    cells = exploded(spark).unionByName(exploded(spark, 7, 5).withColumn("sheet", F.lit("t")))
    expected = sorted(rows(rm.find_table_regions(cells)))
    monkeypatch.setattr(regions, "CELLS_PER_TASK", 50)
    assert sorted(rows(rm.find_table_regions(cells))) == expected
    monkeypatch.setattr(regions, "SENT_ROWS", 0)
    assert sorted(rows(rm.find_table_regions(cells))) == expected


def test_cells_are_not_broadcast_to_read_a_region(spark, monkeypatch):
    from rowmill.sources import regions

    cells, headers = exploded(spark), [f"h{i}" for i in range(1, 13)]
    table = rm.read_region(cells, rm.find_table_regions(cells), headers)
    assert "BuildLeft" not in plan(table)  # the cells are the left side
    expected = sorted(rows(table))
    assert len(expected) == 39 and expected[0][:2] == ("f", "s")
    monkeypatch.setattr(regions, "CELLS_PER_TASK", 50)
    monkeypatch.setattr(regions, "SENT_ROWS", 0)
    assert sorted(rows(rm.read_region(cells, rm.find_table_regions(cells), headers))) == expected


@pytest.mark.parametrize("options", [{"width": 3}, {}])
def test_lines_of_one_file_meet_in_no_task(spark, tmp_path, options):
    """A long file is numbered by the places of its lines, whether the width is given or not; quotes inside a line change nothing."""
    (tmp_path / "a.csv").write_text('k,v,w\n' + "".join(f'{i},"x, {i}",\n' for i in range(30)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90b")
    try:
        cells = rm.cells_from_csv(spark, str(tmp_path / "a.csv"), **options)
        assert cells.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [(1, 1, "k"), (1, 2, "v"), (1, 3, "w"), *[x for i in range(30) for x in ((i + 2, 1, str(i)), (i + 2, 2, f"x, {i}"))]]
    assert sorted(rows(cells, "row", "col", "value")) == expected


@pytest.mark.parametrize("repeats", [1, 2])
@pytest.mark.parametrize("note", ["plain", 'two\nlines, "a"\n\nand more'])
def test_files_of_many_splits(spark, tmp_path, note, repeats):
    """Every split of a file begins with the number and the open quote that the earlier ones leave; a file may be named twice."""
    import csv

    table = [[str(i), note if i % 3 else "x", f"z{i}"] for i in range(40)]
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as file:
            csv.writer(file, lineterminator="\n").writerows(table)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90b")
    try:
        cells = rm.cells_from_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), str(tmp_path / "b.csv")][: repeats + 1], rows_per_task=5, escape='"').cache()
        cells.count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [(r, c, v) for r, line in enumerate(table, 1) for c, v in enumerate(line, 1)]
    assert sorted(rows(cells.where("sheet = 'a'"), "row", "col", "value")) == expected
    if repeats == 1:
        assert sorted(rows(cells.where("sheet = 'b'"), "row", "col", "value")) == expected
    cells.unpersist()


@pytest.mark.parametrize("size", [2, 10**6])
def test_lines_are_matched_once(spark, tmp_path, size):
    """What a line does to an open quote is found when the lines are written, not again in each pass."""
    (tmp_path / "a.csv").write_text('1,"x\ny"\n2,"z"\n' * 5)
    cells = rm.cells_from_csv(spark, str(tmp_path / "a.csv"), width=2, rows_per_task=size, escape='"')
    conditions = [x for x in plan(cells).splitlines() if "RLIKE" in x and "{" not in x]
    assert not [x for x in conditions if '"' in x]
    assert sorted(rows(cells, "row", "col", "value"))[:4] == [(1, 1, "1"), (1, 2, "x\ny"), (2, 1, "2"), (2, 2, "z")]
