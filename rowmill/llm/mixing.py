"""Mixing sources to target weights with nested hash thresholds.

A document is taken as often as its source's budget covers all of it, and once
more if its hash lies below the source's threshold. The threshold is found without
sorting: sizes are summed by source and hash bucket, the bucket in which the budget
ends is cut into finer buckets, and so on until it holds one row. Thresholds for
smaller budgets lie below those for larger ones, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.plans.lineage import written

#: Sources up to which the table of thresholds is sent to all tasks; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Hex digits that one level of buckets uses: 4096 buckets. A row's code has 15 digits of its key's hash and 16 of its size,
#: and 16 that only tell apart rows equal in both.
STEP, DIGITS = 3, 47


def budgets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """Targets for a table with one row per source (`source`, `source_size`): columns weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of
    all sizes; a target stops at `most` times its source's size, and the excess is
    shared among the others by weight. Sources are few against documents: one
    window without partitions numbers them and runs over them.
    """
    weighed = sizes.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    # sources reach their cap in the order of cap per weight; before each, what is left goes by weight to those after it
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    capped = weighed.withColumn("level", level).withColumn("cap", most * F.col("source_size").cast("double"))
    share = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everything)
    target = F.coalesce(F.least(F.col("cap"), share * F.col("weight")), F.col("cap"))
    return capped.select("source", "source_size", F.col("weight").cast("int").alias("weight"), target.alias("target"))


def _join_sources(rows: DataFrame, per_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join by source, null equal to null; broadcast only if there are few sources."""
    per_source = per_source.withColumnRenamed("source", "source_")
    return rows.join(F.broadcast(per_source) if few else per_source, rows["source"].eqNullSafe(F.col("source_")), how).drop("source_")


def mix(docs: DataFrame, size: Column, most: float = 3.0, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """Every row of `docs` (`key`, source) with size, source_size, target and taken.

    `taken` is size times a whole number from 0 to `most` (rounded down), chosen so
    that the taken sizes of a source come as near to its target as the hash order
    of its documents allows: within half a document. Reruns, and tables stored in
    another way, give the same. A null key is a key; rows of equal key and source
    follow each other. Sources of size 0, null texts and empty tables take nothing.
    Only the key, the source, what `size` needs and the columns in `carry` are read and
    returned.
    """
    carry = carry or []
    digest = F.substring(F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 15)
    sized = docs.select(F.col(key).alias("key"), *carry, F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), digest.alias("h"))
    # the code counts a row's place in the written table last: it parts rows that are equal in all that is returned
    rows = written(sized, "mixing").withColumn("place", F.monotonically_increasing_id())
    hex16 = lambda number: F.lpad(F.hex(number), 16, "0")
    rows = rows.select("key", *carry, "source", "size", F.concat("h", hex16(F.col("size")), hex16(F.xxhash64("place"))).alias("code"))
    per_source = written(budgets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most), "budgets")
    few = per_source.count() <= BROADCAST_SOURCES
    # whole rounds that the budget covers, and the rest that a threshold must meet
    total, cap = F.col("source_size").cast("double"), F.lit(int(most)).cast("long")
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / total), cap)).otherwise(F.lit(0)).cast("long")
    plan = per_source.withColumn("times", times).withColumn("rest", F.when(F.col("times") < cap, F.greatest(F.lit(0.0), F.col("target") - F.col("times") * total)).otherwise(0.0))

    open_, edges = plan.select("source", "rest", F.lit("").alias("prefix")), None
    for digits in range(STEP, DIGITS + STEP, STEP):
        bucket = F.substring("code", 1, digits)
        inside = _join_sources(rows.where("size > 0"), open_, few).where(F.substring("code", 1, digits - STEP) == F.col("prefix"))
        sums = inside.groupBy("source", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ending = sums.withColumn("before", upto - F.col("n")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
        found = written(ending.select("source", (F.col("rest") - F.col("before")).alias("rest"), F.col("bucket").alias("prefix"), "n", "rows"), "thresholds")
        ended = found.where("rows = 1")
        edges = ended if edges is None else edges.unionByName(ended)
        open_ = found.where("rows > 1").select("source", "rest", "prefix")
        if open_.isEmpty():
            break

    last = edges.select("source", F.col("rest").alias("left"), "prefix", "n")
    joined = _join_sources(_join_sources(rows, plan.select("source", "source_size", "target", "times", "rest"), few), last, few, "left")
    head = F.expr("left(code, length(prefix))")
    below = (head < F.col("prefix")) | ((head == F.col("prefix")) & (2 * F.col("left") > F.col("n")))
    # no last bucket: the rest is nothing, or by rounding all of the source
    extra = F.when(F.col("prefix").isNull(), F.col("rest") >= F.greatest(F.col("source_size"), F.lit(1))).otherwise(below)
    taken = F.col("size") * (F.col("times") + extra.cast("long"))
    return joined.select(F.col("key").alias(key), *carry, "source", "size", "source_size", "target", taken.alias("taken"))
