"""Lists of named steps: running, previewing, checking and tidying them.

A step is ``{"function": name, "params": {…}}``. A list builds one lazy
DataFrame, so Catalyst plans the whole chain at once.
"""

from __future__ import annotations

import inspect
import copy
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from rowmill.functions.columns import columns_of
from rowmill.functions.predicates import all_of, as_flag, predicate
from rowmill.operators import DATA_OPERATORS, FORMAT_OPERATORS, HIGHLIGHT_OPERATORS, OPERATORS, OUTPUT_OPERATORS
from rowmill.operators.totals import _conditions
from rowmill.streaming import require_row_wise

Step = dict[str, Any]

# Steps after which the number of rows is known without counting.
KEEPS_ROWS = frozenset({
    "select_columns", "reorder_columns", "drop_columns", "normalize_column_names", "convert_column_type",
    "fill_missing_values", "normalize_text", "replace_values", "replace_text", "extract_text", "split_column",
    "combine_columns", "clean_numeric_values", "round_numbers", "calculate_column", "compare_columns",
    "add_date_parts", "calculate_date_difference", "add_conditional_column", "sort_rows", "rank_rows",
    "cumulative_sum", "percent_change", "mark_duplicates", "mark_missing_required", "mark_error_values",
    *OUTPUT_OPERATORS,
})
ADDS_ONE = ("add_total_row", "add_conditional_summary_row")
FILTERS = ("filter_rows", "filter_by_conditions", "filter_relative_dates", "filter_calendar_period")
# A live cell formula is no notion of a table; the flag is accepted and values are computed.
FORMULA_STEPS = ("calculate_column", "calculate_date_difference", "add_subtotals")
COLUMN_PARAMETERS = frozenset({
    "column", "columns", "subset", "group_columns", "index_columns", "pivot_column", "value_column",
    "value_columns", "left_column", "right_column", "order_columns", "target_columns", "start_column", "end_column",
    "date_column", "condition_column", "output_column", "label_column",
})


class StepError(ValueError):
    """A step list that cannot be applied, with the number of the step."""

    def __init__(self, number: int, step: Step, reason: object):
        super().__init__(f"step {number} ({step.get('function')}): {reason}")
        self.number = number


def _parameters(number: int, step: Step) -> dict[str, Any]:
    """The step's parameters, checked against the operator's signature."""
    name = step.get("function")
    if name not in OPERATORS:
        raise StepError(number, step, "unknown function")
    params = dict(step.get("params") or {})
    if name in FORMULA_STEPS:
        params.pop("as_formula", None)
    known = list(inspect.signature(OPERATORS[name]).parameters.values())[1:]
    missing = [p.name for p in known if p.default is p.empty and p.name not in params]
    unknown = sorted(set(params) - {p.name for p in known})
    if missing:
        raise StepError(number, step, f"missing parameters: {', '.join(missing)}")
    if unknown:
        raise StepError(number, step, f"unknown parameters: {', '.join(unknown)}")
    return params


def _in_phases(steps: list[Step]) -> list[tuple[int, Step, dict[str, Any]]]:
    """Numbered steps in running order: data, highlights, summary rows, display formats."""
    if not steps:
        raise ValueError("there is no step to apply")
    checked = [(i, step, _parameters(i, step)) for i, step in enumerate(steps, start=1)]
    output = False
    for i, step, _ in checked:
        if step["function"] in OUTPUT_OPERATORS:
            output = True
        elif output:
            raise StepError(i, step, "data steps come before presentation steps")

    def phase(item: tuple[int, Step, dict[str, Any]]) -> int:
        name = item[1]["function"]
        return 0 if name in DATA_OPERATORS else 1 if name in HIGHLIGHT_OPERATORS else 3 if name in FORMAT_OPERATORS else 2

    return sorted(checked, key=phase)


def _apply(df: DataFrame, number: int, step: Step, params: dict[str, Any]) -> DataFrame:
    try:
        require_row_wise(df, step["function"])
        return OPERATORS[step["function"]](df, **params)
    except StepError:
        raise
    except (KeyError, TypeError, ValueError) as error:
        raise StepError(number, step, error.args[0] if error.args else error) from error


def apply_steps(df: DataFrame, steps: list[Step], guards: bool = False) -> DataFrame:
    """The table after all steps. With `guards` the checks of `check_steps` run first."""
    if guards:
        check_steps(df, steps)
    for number, step, params in _in_phases(steps):
        df = _apply(df, number, step, params)
    return df


def _affected(df: DataFrame, name: str, params: dict[str, Any]) -> Column | None:
    """Which rows a presentation step picks by condition."""
    if name == "highlight_rows":
        return as_flag(predicate(df, params["column"], params["operator"], params["value"]))
    if name == "add_conditional_summary_row":
        tests = _conditions(*[params.get(k) for k in ("condition_column", "operator", "value", "conditions")])
        return as_flag(all_of(df, tests))
    return None


class _Counter:
    """Counts taken on the way through one chain of steps, all of them by the one job that ends it."""

    def __init__(self) -> None:
        self.seen: list[tuple[Observation, list[str]]] = []
        self.found: dict[str, int] = {}

    def watch(self, df: DataFrame, counts: dict[str, Column]) -> DataFrame:
        """The table, with counts over its rows noted under names."""
        watched = Observation()
        self.seen.append((watched, list(counts)))
        return df.observe(watched, *[F.coalesce(c, F.lit(0)).alias(n) for n, c in counts.items()])

    def run(self, df: DataFrame) -> None:
        df.count()
        for watched, names in self.seen:
            got = watched.get
            # an optimizer that knows a part to be empty leaves it out, and its counts with it
            self.found |= {n: got.get(n, 0) for n in names}


def preview_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows before and after each step: (step, function, before_rows, after_rows, affected_rows, groups).

    One job over one chain: the counts are noted as rows pass the steps that change
    their number, and presentation steps are not run, as what they add is known. Runs
    when called; the result has a row per step.
    """
    ordered, counter = _in_phases(steps), _Counter()
    one = F.count(F.lit(1))
    data = counter.watch(df, {"rows_0": one})
    after, at = {}, "rows_0"
    for number, step, params in ordered:
        if step["function"] in DATA_OPERATORS:
            data = _apply(data, number, step, params)
            if step["function"] not in KEEPS_ROWS:
                at = f"rows_{number}"
                data = counter.watch(data, {at: one})
        after[number] = at
    tests = {f"affected_{n}": _affected(data, s["function"], p) for n, s, p in ordered if s["function"] in OUTPUT_OPERATORS}
    tests = {n: F.count_if(t) for n, t in tests.items() if t is not None}
    if tests:
        data = counter.watch(data, tests)
    counter.run(data)
    result, rows = [], counter.found["rows_0"]
    for number, step, params in ordered:
        name, before, groups = step["function"], rows, None
        if name in OUTPUT_OPERATORS:
            rows += name in ADDS_ONE
        else:
            rows = counter.found[after[number]]
        if name == "add_subtotals":
            groups = rows - before - bool(params.get("include_grand_total", True))
        result.append((number, name, before, rows, counter.found.get(f"affected_{number}"), groups))
    schema = "step int, function string, before_rows bigint, after_rows bigint, affected_rows bigint, groups bigint"
    return df.sparkSession.createDataFrame(result, schema)


def check_steps(df: DataFrame, steps: list[Step]) -> list[dict[str, Any]]:
    """Run the preview and raise on results that are surely not meant.

    Refused are a filter that leaves nothing of a filled table, subtotals for
    more groups than half the rows, and a highlight that matches no row.
    """
    found = [row.asDict() for row in preview_steps(df, steps).orderBy("step").collect()]  # one row per step
    for row in found:
        step = steps[row["step"] - 1]
        if step["function"] in FILTERS and row["before_rows"] and not row["after_rows"]:
            raise StepError(row["step"], step, "the filter leaves no row")
        if step["function"] == "add_subtotals" and (row["groups"] or 0) > 0.5 * row["before_rows"]:
            raise StepError(row["step"], step, f"{row['groups']} subtotal groups for {row['before_rows']} rows")
        if step["function"] == "highlight_rows" and not row["affected_rows"]:
            raise StepError(row["step"], step, "no row matches the highlight")
    return found


# ------------------------------------------------------------------ tidying


#: Operators that change nothing when they are applied again right away.
ONCE_IS_ENOUGH = {
    "select_columns", "reorder_columns", "drop_columns", "convert_column_type", "remove_empty_rows", "remove_duplicates", "drop_rows_missing_keys",
    "fill_missing_values", "select_visible_rows", "normalize_text", "clean_numeric_values", "round_numbers", "filter_rows", "filter_by_conditions",
    "filter_relative_dates", "filter_calendar_period", "sort_rows", "select_top_n", "keep_latest_per_group", "highlight_rows", "highlight_extremes",
    "highlight_missing", "format_numbers", "color_scale", "mark_missing_required", "mark_error_values",
}
NULL_TESTS = {"==": "is_null", "!=": "not_null"}


def _null_tests(params: dict[str, Any]) -> dict[str, Any]:
    """Parameters in which every condition on null is written as is_null or not_null.

    Conditions are dictionaries with an operator; they stand in lists and under any key.
    """
    out = copy.deepcopy(params)
    left: list[Any] = [out]
    while left:
        node = left.pop()
        left += node.values() if isinstance(node, dict) else node if isinstance(node, list) else ()
        if isinstance(node, dict) and node.get("value") is None and node.get("operator") in NULL_TESTS:
            node["operator"] = NULL_TESTS[node["operator"]]
    return out


def _as_aggregates(step: Step) -> list[dict[str, str]]:
    """A grouping step as a list of named aggregates."""
    params = step["params"]
    if step["function"] == "group_aggregate":
        return list(params["aggregations"])
    key = columns_of(params["group_columns"])[0]
    return [{"column": key, "function": "size", "result_column": params.get("result_column", "count")}]


def _merged(first: Step, second: Step) -> Step | None:
    """Two neighbouring aggregates over the same keys as one, saving a shuffle."""
    names = (first["function"], second["function"])
    if "group_aggregate" not in names or not set(names) <= {"group_aggregate", "group_count"}:
        return None
    keys = [columns_of(s["params"].get("group_columns")) for s in (first, second)]
    if keys[0] != keys[1]:
        return None
    # An aggregate over a result of the first one is a second aggregation, not a part of the same.
    made = {item["result_column"] for item in _as_aggregates(first)}
    if made & {item["column"] for item in _as_aggregates(second) if item["function"] != "size"}:
        return None
    both = _as_aggregates(first) + _as_aggregates(second)
    return {"function": "group_aggregate", "params": {"group_columns": first["params"]["group_columns"], "aggregations": both}}


def _renamed(value: Any, names: dict[str, str], column: bool = False) -> Any:
    """Column references replaced by the names earlier steps gave them."""
    if isinstance(value, dict):
        return {k: _renamed(v, names, k in COLUMN_PARAMETERS) for k, v in value.items()}
    if isinstance(value, list):
        return [_renamed(v, names, column) for v in value]
    return names.get(value, value) if column and isinstance(value, str) else value


def _new_names(step: Step) -> dict[str, str]:
    """Columns a step consumes and the result that takes their place."""
    params = step["params"]
    if step["function"] in ("group_sum", "group_average") and "result_column" in params:
        pairs = [(params["value_column"], params["result_column"])]
    elif step["function"] == "group_aggregate":
        pairs = [(i["column"], i["result_column"]) for i in params["aggregations"]]
    elif step["function"] == "normalize_column_names":
        pairs = list(params["mapping"].items())
    else:
        return {}
    kept = columns_of(params.get("group_columns"))
    return {old: new for old, new in pairs if old != new and old not in kept}


def normalize_steps(steps: list[Step]) -> list[Step]:
    """An equivalent, tidier list: null tests, merged aggregates, names followed.

    A step that repeats the one right before it is dropped if doing it twice changes
    nothing more.
    """
    result: list[Step] = []
    for raw in steps:
        step = {"function": raw["function"], "params": _null_tests(raw.get("params") or {})}
        if result and step == result[-1] and step["function"] in ONCE_IS_ENOUGH:
            continue
        merged = _merged(result[-1], step) if result else None
        result[-1:] = [merged] if merged else [*result[-1:], step]
    names: dict[str, str] = {}
    followed = []
    for step in result:
        step = {"function": step["function"], "params": _renamed(step["params"], names)}
        followed.append(step)
        new = _new_names(step)
        names = {old: new.get(current, current) for old, current in names.items()} | new
        made = [v for k, v in step["params"].items() if k.endswith("result_column")]
        names = {old: current for old, current in names.items() if old not in made}
    return followed
