import pytest
from pyspark.sql import functions as F

import rowmill as rm
from rowmill.streaming import ROW_WISE
from tests.conftest import rows, values


@pytest.fixture
def orders(table):
    return table(
        "customer string, received string, completed string, amount string, temp int",
        ("A", "2026-01-01", "2026-01-05", "1,200", 1), ("A", "2026-02-01", "2026-02-04", "2,500", 2),
        ("B", "2026-01-01", "2026-01-10", "900", 3),
    )


STEPS = [
    {"function": "clean_numeric_values", "params": {"columns": ["amount"]}},
    {"function": "round_numbers", "params": {"columns": ["amount"], "decimals": 0}},
    {"function": "add_conditional_column", "params": {
        "result_column": "grade", "conditions": [{"column": "amount", "operator": ">=", "value": 1000}],
        "true_value": "high", "false_value": "normal"}},
    {"function": "calculate_date_difference", "params": {
        "start_column": "received", "end_column": "completed", "result_column": "days", "as_formula": True}},
    {"function": "combine_columns", "params": {"columns": ["customer", "grade"], "result_column": "label", "separator": "-"}},
    {"function": "keep_latest_per_group", "params": {
        "group_columns": ["customer"], "date_column": "received", "order_columns": "temp"}},
    {"function": "drop_columns", "params": {"columns": ["temp"]}},
]


def test_a_chain_of_steps(orders):
    out = rm.apply_steps(orders, STEPS, guards=True)
    assert rows(out, "customer", "amount", "days", "label", order="customer") == [
        ("A", 2500.0, 3.0, "A-high"), ("B", 900.0, 9.0, "B-normal"),
    ]


def test_preview_counts(orders):
    steps = [*STEPS, {"function": "highlight_rows", "params": {"column": "amount", "operator": ">", "value": 1000, "color": "red"}}]
    got = rows(rm.preview_steps(orders, steps), "step", "before_rows", "after_rows", "affected_rows", order="step")
    assert got == [(i, 3, 3, None) for i in range(1, 6)] + [(6, 3, 2, None), (7, 2, 2, None), (8, 2, 2, 1)]


def test_a_preview_reads_every_row_once(spark):
    read = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: read.add(1) or v, "long").asNondeterministic()
    df = spark.range(1000).select(counted("id").alias("id"), (F.col("id") % 10).alias("g"), (F.col("id") * 2).alias("v"))
    steps = [
        {"function": "calculate_column", "params": {"result_column": "w", "operator": "add", "left_column": "v", "right_column": "id"}},
        {"function": "filter_rows", "params": {"column": "w", "operator": ">", "value": 300}},
        {"function": "group_sum", "params": {"group_columns": "g", "value_column": "w", "result_column": "s"}},
        {"function": "filter_rows", "params": {"column": "s", "operator": ">", "value": 10**9}},
        {"function": "add_total_row", "params": {"value_columns": ["s"]}},
        {"function": "highlight_rows", "params": {"column": "s", "operator": ">", "value": 1, "color": "red"}},
    ]
    found = rm.preview_steps(df, steps)
    assert read.value == 1000
    got = rows(found, "step", "before_rows", "after_rows", "affected_rows", order="step")
    assert got == [(1, 1000, 1000, None), (2, 1000, 899, None), (3, 899, 10, None), (4, 10, 0, None), (5, 0, 1, None), (6, 0, 0, 0)]


def test_previews_of_subtotals_and_of_nothing(spark, table):
    df = table("g string, v int", ("a", 1), ("a", 2), ("b", 3))
    steps = [{"function": "add_subtotals", "params": {"group_columns": "g", "value_columns": "v"}}]
    assert rows(rm.preview_steps(df, steps), "before_rows", "after_rows", "groups") == [(3, 6, 2)]
    assert rows(rm.preview_steps(df.limit(0), steps), "before_rows", "after_rows", "groups") == [(0, 1, 0)]
    nothing = [{"function": "filter_rows", "params": {"column": "v", "operator": ">", "value": 9}},
               {"function": "group_count", "params": {"group_columns": "g"}}, {"function": "select_top_n", "params": {"column": "count", "n": 2}}]
    assert rows(rm.preview_steps(df, nothing), "before_rows", "after_rows", order="step") == [(3, 0), (0, 0), (0, 0)]


@pytest.mark.parametrize("step, message", [
    ({"function": "explode_it"}, "unknown function"),
    ({"function": "filter_rows", "params": {"column": "amount"}}, "missing parameters: operator, value"),
    ({"function": "sort_rows", "params": {"columns": "amount", "limit": 3}}, "unknown parameters: limit"),
    ({"function": "drop_columns", "params": {"columns": ["absent"]}}, "no such column: absent"),
])
def test_bad_steps_name_their_number(orders, step, message):
    with pytest.raises(rm.StepError, match=message) as error:
        rm.apply_steps(orders, [STEPS[0], step])
    assert error.value.number == 2


def test_presentation_comes_last_and_runs_in_phases(orders):
    paint = {"function": "highlight_rows", "params": {"column": "temp", "operator": ">", "value": 1, "color": "blue"}}
    total = {"function": "add_total_row", "params": {"value_columns": ["temp"]}}
    shown = {"function": "format_numbers", "params": {"columns": ["temp"], "format": "decimal_1"}}
    out = rm.apply_steps(orders, [shown, total, paint])
    assert sorted(values(out, "temp_fmt")) == ["1.0", "2.0", "3.0", "6.0"]
    assert values(out.filter("_row_kind = 'summary'"), "highlight") == [None]
    with pytest.raises(rm.StepError, match="before presentation"):
        rm.apply_steps(orders, [paint, STEPS[0]])
    with pytest.raises(ValueError):
        rm.apply_steps(orders, [])


@pytest.mark.parametrize("step, message", [
    ({"function": "filter_rows", "params": {"column": "temp", "operator": ">", "value": 9}}, "no row"),
    ({"function": "add_subtotals", "params": {"group_columns": "temp", "value_columns": "temp"}}, "3 subtotal groups"),
    ({"function": "highlight_rows", "params": {"column": "temp", "operator": ">", "value": 9, "color": "red"}}, "no row matches"),
])
def test_guards(orders, step, message):
    rm.apply_steps(orders, [step])
    with pytest.raises(rm.StepError, match=message):
        rm.apply_steps(orders, [step], guards=True)


def test_tidied_steps():
    tidy = rm.normalize_steps([
        {"function": "filter_rows", "params": {"column": "s", "operator": "==", "value": None}},
        {"function": "filter_rows", "params": {"column": "s", "operator": "==", "value": None}},
        {"function": "group_aggregate", "params": {"group_columns": ["g"], "aggregations": [{"column": "v", "function": "sum", "result_column": "total"}]}},
        {"function": "group_aggregate", "params": {"group_columns": ["g"], "aggregations": [{"column": "w", "function": "max", "result_column": "top"}]}},
        {"function": "group_count", "params": {"group_columns": "g", "result_column": "n"}},
        {"function": "sort_rows", "params": {"columns": ["v", "g"]}},
    ])
    assert [s["function"] for s in tidy] == ["filter_rows", "group_aggregate", "sort_rows"]
    assert tidy[0]["params"]["operator"] == "is_null"
    assert [a["result_column"] for a in tidy[1]["params"]["aggregations"]] == ["total", "top", "n"]
    assert tidy[2]["params"]["columns"] == ["total", "g"]


def test_tidied_steps_keep_second_aggregations_and_new_columns():
    steps = [
        {"function": "group_aggregate", "params": {"group_columns": ["g"], "aggregations": [{"column": "v", "function": "sum", "result_column": "total"}]}},
        {"function": "group_aggregate", "params": {"group_columns": ["g"], "aggregations": [{"column": "total", "function": "max", "result_column": "top"}]}},
        {"function": "calculate_column", "params": {"result_column": "v", "operator": "multiply", "left_column": "top", "value": 2}},
        {"function": "sort_rows", "params": {"columns": ["v"]}},
    ]
    assert rm.normalize_steps(steps) == steps


def test_steps_on_a_stream(spark, tmp_path, orders):
    orders.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    steps = [s for s in STEPS if s["function"] in ROW_WISE]
    out = rm.apply_steps(stream, steps)
    query = out.writeStream.format("memory").queryName("stepped").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        assert sorted(values(spark.table("stepped"), "label")) == ["A-high", "A-high", "B-normal"]
    finally:
        query.stop()
    with pytest.raises(rm.StepError, match="cannot run on a stream"):
        rm.apply_steps(stream, [STEPS[5]])
