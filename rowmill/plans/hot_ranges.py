"""Ordered windows whose groups may be far too large for one task.

``Window.partitionBy(group)`` sends a whole group to one task, and a window
without a group sends the whole table there. Here such a *hot* group is cut
into ranges of its order columns. Each range is a window partition of its own,
and what the earlier ranges of the group contribute is carried in from a small
table with one row per range.

Two small jobs decide whether this is needed: a row count, and, above
`rows_per_task` rows, a sample of the key columns that finds the hot groups and
their range bounds. The sample only steers the balance of the tasks. Every row
falls into exactly one range whatever the bounds are, so results are exact.
Without hot groups the plan is the ordinary one-shuffle window.

Where one key value alone fills more than a range, its rows would still meet in one
task. If the sample shows such a value (a bound that comes twice), a hash of the row
and its position are added behind the order columns, which cuts the value too; what
earlier ranges contribute is carried on as before. Without such values nothing is added.

The bounds are values, not partition numbers, so a recomputed task assigns its
rows to the same ranges as the lost one did.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill.functions.columns import col, columns_of, is_floating, is_missing, kind, require_columns, type_of

ROWS_PER_TASK = 2_000_000
MAX_RANGES = 50_000  # also bounds every table that is broadcast here
SAMPLES_PER_RANGE = 50
SOURCE_FILE, SOURCE_BLOCK, SOURCE_ROW = "_source_file", "_source_block", "_source_row"

TIE, SPOT = "_tie", "_spot"  # what parts rows that tie on all order columns: a hash of the row, then its position
RANGE = "_range"  # place of the row's range within all ranges; -1 for rows of groups that stay whole
JSON_OPTIONS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@dataclass(frozen=True)
class Order:
    """One sort key; nulls and NaN come last in both directions."""

    column: str
    ascending: bool = True


def order_of(df: DataFrame, order_columns: Sequence[str] | str | None, operation: str) -> list[Order]:
    """Row order given by the caller, else the position in the source."""
    names = columns_of(order_columns) or source_order(df)
    if not names:
        raise ValueError(f"{operation} depends on row order: give order_columns, or load with source metadata")
    require_columns(df, names)
    return [Order(n) for n in names]


def source_order(df: DataFrame) -> list[str]:
    if SOURCE_ROW not in df.columns:
        return []
    return [n for n in (SOURCE_FILE, SOURCE_BLOCK, SOURCE_ROW) if n in df.columns]


def sort_columns(df: DataFrame, order: Sequence[Order]) -> list[Column]:
    result = []
    for item in order:
        c = col(item.column)
        if is_floating(type_of(df, item.column)):
            c = F.nanvl(c, F.lit(None).cast(type_of(df, item.column)))
        result.append(c.asc_nulls_last() if item.ascending else c.desc_nulls_last())
    return result


def needs_split(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> bool:
    """One count job: could any group be larger than a task should hold?"""
    return df.count() > rows_per_task


@dataclass(frozen=True)
class Split:
    """Rows ready for an ordered window, hot groups already cut into ranges."""

    rows: DataFrame
    keys: list[str]
    order: list[Order]
    sort: list[Column] = field(default_factory=list)
    cut: Column | None = None  # test for rows of hot groups; None when no group is cut

    @property
    def hot(self) -> bool:
        return self.cut is not None

    @property
    def window(self) -> WindowSpec:
        parts = [col(k) for k in self.keys] + ([F.col(RANGE)] if self.hot else [])
        return Window.partitionBy(*parts).orderBy(*self.sort)

    @property
    def running(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _hot_groups(self, totals: dict[str, Column], by_range: bool) -> DataFrame:
        names = [*[col(k) for k in self.keys], *([F.col(RANGE)] if by_range else [])]
        aggregates = [c.alias(n) for n, c in totals.items()]
        hot = self.rows.filter(self.cut) if self.keys else self.rows
        return hot.groupBy(*names).agg(*aggregates) if names else hot.agg(*aggregates)

    def _attach(self, df: DataFrame, table: DataFrame, by_range: bool) -> DataFrame:
        renamed = {k: f"_key{i}" for i, k in enumerate(self.keys)}
        table = table.withColumnsRenamed(renamed)
        match = [col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()]
        if by_range:
            table = table.withColumnRenamed(RANGE, "_key_range")
            match.append(F.col(RANGE) == F.col("_key_range"))
        # One row per range of a hot group, so at most MAX_RANGES rows and their groups.
        joined = df.join(F.broadcast(table), match, "left")
        return joined.drop(*renamed.values(), "_key_range")

    def carry(self, df: DataFrame, totals: dict[str, Column], last: bool = False) -> DataFrame:
        """Add what earlier ranges of the row's group contribute, null for the first one.

        Each total is summed over the earlier ranges, or with `last` the value of
        the nearest earlier range that has one is taken.
        """
        table = self._hot_groups(totals, by_range=True)
        earlier = Window.partitionBy(*[col(k) for k in self.keys]).orderBy(RANGE).rowsBetween(
            Window.unboundedPreceding, -1
        )
        combine = (lambda c: F.last(c, ignorenulls=True)) if last else F.sum
        table = table.select(
            *[col(k) for k in self.keys], RANGE, *[combine(F.col(n)).over(earlier).alias(n) for n in totals]
        )
        return self._attach(df, table, by_range=True)

    def totals(self, df: DataFrame, totals: dict[str, Column]) -> DataFrame:
        """Add totals of the row's group: a join for hot groups, a window for the others."""
        whole = Window.partitionBy(*[col(k) for k in self.keys])
        if not self.hot:
            return df.withColumns({n: c.over(whole) for n, c in totals.items()})
        within = Window.partitionBy(*[col(k) for k in self.keys], F.col(RANGE))
        table = self._hot_groups(totals, by_range=False)
        names = {n: f"_hot_{n}" for n in totals}
        table = table.withColumnsRenamed(names)
        if self.keys:
            df = self._attach(df, table, by_range=False)
            found = {n: F.col(h) for n, h in names.items()}
        else:
            found = {n: table.select(h).scalar() for n, h in names.items()}
        df = df.withColumns({
            n: F.when(self.cut, found[n]).otherwise(c.over(within)) for n, c in totals.items()
        })
        return df.drop(*names.values())

    def finish(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return df.drop(RANGE, TIE, SPOT, *extra)


def _turned(c: Column, data_type: T.DataType) -> Column | None:
    """A value that sorts the other way round, or None where there is none."""
    if isinstance(data_type, T.IntegralType):
        return F.bitwise_not(c)
    if kind(data_type) == "number":
        return -c
    if isinstance(data_type, T.BooleanType):
        return ~c
    if isinstance(data_type, T.DateType):
        return -F.datediff(c, F.lit("1970-01-01").cast("date"))
    if kind(data_type) == "datetime":
        since = c.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
        return -since.cast("interval second").cast("decimal(20,6)")
    return None


def _key(df: DataFrame, keys: Sequence[str], order: Sequence[Order]) -> tuple[Column, bool]:
    """Group hash and order of a row as one comparable struct, and whether it ascends.

    Each order column gives a null flag, so that null comes last, and its value.
    When directions are mixed, values are turned. A text cannot be; it sets the
    direction, and a second text in the other one ends the key.
    """
    fixed = [o.ascending for o in order if _turned(col(o.column), type_of(df, o.column)) is None]
    ascending = fixed[0] if fixed else any(o.ascending for o in order)
    fields: list[Column] = [_hash(keys).alias("h")] if keys else []
    for i, item in enumerate(order):
        missing = is_missing(df, item.column)
        value: Column | None = F.when(~missing, col(item.column))
        if item.ascending != ascending:
            value = _turned(value, type_of(df, item.column))
        if value is None:
            break
        fields += [(missing if ascending else ~missing).alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*fields), ascending


def _hash(keys: Sequence[str]) -> Column:
    """Groups that share a hash share their bounds, which is harmless: bounds only cut, they never join."""
    return F.xxhash64(*[col(k) for k in keys])


def _place(bounds: Column, size: int, key: Column, ascending: bool) -> Column:
    """The range of a row: bounds below its key, by binary search in a constant array."""
    jumps = F.array(*[F.lit(2**i) for i in reversed(range(size.bit_length()))])

    def search(row: Column) -> Column:
        return F.aggregate(
            jumps, F.lit(0), lambda at, jump: at + F.when(F.get(bounds, at + jump - 1) < row, jump).otherwise(F.lit(0))
        )

    # `transform` over one element computes the key once for all steps.
    at = F.get(F.transform(F.array(key), search), F.lit(0))
    return at if ascending else F.lit(size) - at


def row_hash(df: DataFrame, names: Sequence[str]) -> Column | None:
    """A hash of the columns of fixed width beside the named ones, so that long texts are read only if there is nothing else."""
    others = [f for f in df.schema.fields if f.name not in names and "map<" not in f.dataType.simpleString()]
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    fixed = [f for f in others if isinstance(f.dataType, plain) or f.name.startswith("_source")]
    chosen = fixed or others
    return F.xxhash64(*[col(f.name) for f in chosen]) if chosen else None


def _bounds(
    df: DataFrame, grouped: bool, key: Column, total: int, rows_per_task: int,
) -> tuple[T.DataType, dict[str, int | None], bool]:
    """Sorted range bounds of all hot groups as JSON texts, each with the hash of its group, and whether a bound came twice."""
    ranges = min(MAX_RANGES, math.ceil(total / rows_per_task))
    fraction = min(1.0, ranges * SAMPLES_PER_RANGE / total)
    per_range = max(1, int(fraction * total / ranges))
    sample = df.select(key.alias("key")).sample(fraction, seed=7)
    # The sample is at most about MAX_RANGES * SAMPLES_PER_RANGE narrow rows in all.
    group = Window.partitionBy(*(["key.h"] if grouped else [])).orderBy("key")
    numbered = sample.withColumn("_row", F.row_number().over(group))
    cuts = numbered.filter(F.col("_row") % per_range == 0).orderBy("key")
    hashed = F.col("key.h") if grouped else F.lit(None).cast("long")
    found = cuts.select(F.to_json("key", JSON_OPTIONS).alias("json"), hashed.alias("h")).collect()  # at most MAX_RANGES rows
    distinct = {row["json"]: row["h"] for row in found}
    return sample.schema["key"].dataType, distinct, len(distinct) < len(found)


def split(
    df: DataFrame, group_columns: Sequence[str] | str | None, order: Sequence[Order],
    rows_per_task: int = ROWS_PER_TASK, only: Column | None = None, cut_ties: bool = False,
) -> Split:
    """Prepare rows for an ordered window. `only` restricts which rows count as load.

    With `cut_ties` rows that tie on all order columns may be parted too; windows must
    then go by the order of the result.
    """
    keys = columns_of(group_columns)
    require_columns(df, keys)
    order = list(order)
    sort = sort_columns(df, order)
    loaded = lambda rows: rows if only is None else rows.filter(only)
    total = loaded(df).count()
    if total <= rows_per_task:
        return Split(df, keys, order, sort)
    key, ascending = _key(df, keys, order)
    key_type, found, tied = _bounds(loaded(df), bool(keys), key, total, rows_per_task)
    if tied and cut_ties:
        part = row_hash(df, [*keys, *[o.column for o in order]])
        df = df.withColumns(({TIE: part} if part is not None else {}) | {SPOT: F.monotonically_increasing_id()})
        order += [Order(n) for n in (TIE, SPOT) if n in df.columns]
        sort = sort_columns(df, order)
        key, ascending = _key(df, keys, order)
        key_type, found, _ = _bounds(loaded(df), bool(keys), key, total, rows_per_task)
    if not found:
        return Split(df, keys, order, sort)
    # One literal holds all bounds; no row carries them.
    bounds = F.from_json(F.lit("[" + ",".join(found) + "]"), T.ArrayType(key_type), JSON_OPTIONS)
    cut = _hash(keys).isin(sorted(set(found.values()))) if keys else F.lit(True)
    place = F.when(cut, _place(bounds, len(found), key, ascending)).otherwise(F.lit(-1))
    return Split(df.withColumn(RANGE, place), keys, order, sort, cut)
