"""Exact values at given places of a column's order, per group, without sorting or gathering values.

Values are counted by buckets that follow their order, combined on the map side: first
by sign and logarithm, then by equal parts between the smallest and largest value of the
one bucket that holds the place. A bucket whose values are all equal ends the search, so
two or three passes over the column do for ordinary data, and a handful for any. What is
kept between passes is a row per group, column and place. All columns and groups take
part in the same passes, and no plan depends on the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.columns import col, columns_of, to_double
from rowmill.plans.lineage import written

#: First buckets per factor of e, beyond the offset of any finite logarithm; and the parts of each further pass.
FINE, OFFSET, PARTS = 64, 200_000, 65_536
#: Bands up to which they are sent to all tasks.
BROADCAST_BANDS = 100_000

COLUMN, PLACE, VALUE, TOTAL = "_column", "_place", "_value", "_total"


def _first_bucket(v: Column) -> Column:
    """A whole number that never falls as the value grows: sign, then logarithm."""
    size = (F.floor(F.least(F.log(F.abs(v)), F.lit(1e3)) * FINE) + OFFSET).cast("int")
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


def _holding(counted: DataFrame, group: list[str], places: Callable[[Column], Column]) -> DataFrame:
    """Buckets that hold a wanted place, each place counted from the bucket's first value."""
    window = Window.partitionBy(*group).orderBy("bucket")
    upto = F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # buckets of a group: at most those of one pass, however many rows it has
    rows = counted.withColumns({"upto": upto, "all": F.sum("n").over(Window.partitionBy(*group))})
    before = F.col("upto") - F.col("n")
    inside = F.filter(places(F.col("all")), lambda p: (p["at"] >= before) & (p["at"] < F.col("upto")))
    moved = F.transform(inside, lambda p: F.struct(p["place"].alias("place"), (p["at"] - before).alias("at"), p["total"].alias("total")))
    return rows.withColumn("places", moved).where(F.size("places") > 0)


def values_at(df: DataFrame, keys: Sequence[str] | str | None, columns: Sequence[str], places: Callable[[Column], list[Column]]) -> DataFrame:
    """(keys, _column, _place, _value, _total): the values at the places that `places` gives for a number of values.

    Places count from 0 in ascending order; those outside of the group have no row.
    Missing and unparseable values are left out, `_total` counts the others. Columns and
    places are named by their position in the lists. Runs its passes at once.
    """
    keys = columns_of(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), to_double(df, c).alias("v")) for i, c in enumerate(columns)])
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], F.explode(cells).alias("cell"))
    # adding zero makes one value of both zeros
    rows = rows.select(*names, F.col("cell.c").alias("c"), (F.col("cell.v") + F.lit(0.0)).alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def wanted(total: Column) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("place"), p.cast("long").alias("at"), total.alias("total")) for i, p in enumerate(places(total))])

    measures = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    counted = rows.groupBy(*names, "c", _first_bucket(F.col("v")).alias("bucket")).agg(*measures)
    kept = [*names, "c", "lo", "hi", "places"]
    found = written(_holding(counted, [*names, "c"], wanted).select(*kept), "bands")
    done = []
    while True:
        done.append(found.where("lo = hi"))
        open_bands = found.where("lo < hi")
        number = open_bands.count()
        if not number:
            break
        bands = open_bands.select(*[F.col(n).alias(f"_b{n}") for n in names], F.col("c").alias("bc"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("places").alias("sought"))
        match = [F.col(n).eqNullSafe(F.col(f"_b{n}")) for n in names] + [F.col("c") == F.col("bc"), F.col("v").between(F.col("from"), F.col("to"))]
        inside = rows.join(F.broadcast(bands) if number <= BROADCAST_BANDS else bands, match)
        part = F.floor((F.col("v") - F.col("from")) / (F.col("to") - F.col("from")) * PARTS).cast("int")
        counted = inside.groupBy(*names, "c", "from", "to", "sought", part.alias("bucket")).agg(*measures)
        found = written(_holding(counted, [*names, "c", "from", "to"], lambda _: F.col("sought")).select(*kept), "bands")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(*names, F.col("c").alias(COLUMN), F.explode("places").alias("p"), F.col("lo").alias(VALUE))
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], COLUMN, F.col("p.place").alias(PLACE), VALUE, F.col("p.total").alias(TOTAL))


def medians(df: DataFrame, keys: Sequence[str] | str | None, columns: dict[str, str]) -> DataFrame:
    """One row per group with a value: the keys and, under each given name, the median of the column it stands for.

    Without keys there is always one row. A group without values of a column has null there.
    """
    keys = columns_of(keys)
    middle = values_at(df, keys, list(columns.values()), lambda n: [F.floor((n - 1) / 2), F.floor(n / 2)])
    parts = [F.avg(F.when(F.col(COLUMN) == i, F.col(VALUE))).alias(name) for i, name in enumerate(columns)]
    return middle.groupBy(*[col(k) for k in keys]).agg(*parts) if keys else middle.agg(*parts)


def nth_value(df: DataFrame, column: str, n: int, largest: bool) -> DataFrame:
    """(_value, _total): the n-th largest or smallest value, or the last one where there are fewer; no row without values."""
    place = lambda total: F.greatest(total - n, F.lit(0)) if largest else F.least(total, F.lit(n)) - 1
    return values_at(df, None, [column], lambda total: [place(total)]).select(VALUE, TOTAL)
