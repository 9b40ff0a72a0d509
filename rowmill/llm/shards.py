"""A reproducible shuffle into shards: a keyed permutation of global row numbers.

Rows get dense numbers in an order that depends on their values alone, and a
Feistel network over the pairs (row number mod a, row number div a) permutes the
numbers; values beyond the number of rows are permuted again until they fall
below it (cycle walking). The permuted place p belongs to shard p mod k, slot
p div k, so shard sizes differ by one row at most, and anyone who knows a row's
number, the number of rows and the seed can compute its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Walks beyond this many steps end in an error. There are fewer than sqrt(n) values beyond the number of rows n,
#: so up to 4096 rows no walk is as long, and for more rows the chance is below 64 ** -64.
LONGEST_WALK = 64
#: Numbers of a repeated row that are listed at a time.
RUN = 100_000


def radices(n: int) -> tuple[int, int]:
    """The smallest nearly square domain a * b of at least n values."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int = 0, rounds: int = 6) -> Column:
    """Place of a row number under a keyed permutation of 0 to n - 1."""
    if n >= 2**52:
        raise ValueError("row numbers must stay below 2 ** 52")
    a, b = radices(n)

    def network(value: Column) -> Column:
        start = F.struct((value % F.lit(a)).alias("l"), F.floor(value / F.lit(a)).cast("long").alias("r"))

        def turn(pair: Column, key: Column) -> Column:
            left, right = pair["l"], pair["r"]
            return F.when(
                key % 2 == 0, F.struct(F.pmod(left + F.pmod(F.xxhash64(right, key, F.lit(seed)), F.lit(a)), F.lit(a)).alias("l"), right.alias("r"))
            ).otherwise(F.struct(left.alias("l"), F.pmod(right + F.pmod(F.xxhash64(left, key, F.lit(seed)), F.lit(b)), F.lit(b)).alias("r")))

        keys = F.array(*[F.lit(k).cast("long") for k in range(rounds)])
        return F.aggregate(keys, start, turn, lambda pair: pair["l"] + pair["r"] * F.lit(a))

    first = network(number)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(LONGEST_WALK)), first, lambda place, _: F.when(place < n, place).otherwise(network(place)))
    walked = F.transform(F.array(walked), lambda place: F.when(place < n, place).otherwise(F.raise_error(F.lit("a walk is too long; take another seed")).cast("long")))[0]
    return F.transform(F.array(first), lambda place: F.when(place < n, place).otherwise(walked))[0]


def row_numbers(df: DataFrame, keys: list[str], buckets: int = 65_536) -> tuple[DataFrame, int]:
    """Distinct rows with how many there are (`copies`) and the number of the first (`first_number`); and the number of all rows.

    Rows are ordered by a hash bucket of all their columns, then by the keys and the
    others; the order depends on values alone, and no value of a key fills a bucket. Equal rows are counted before the shuffle, so a
    row that is repeated many times is one row in it. At most `buckets` counts
    reach the driver.
    """
    bucket = F.pmod(F.xxhash64(*df.columns), F.lit(buckets))
    sizes = dict(df.groupBy(bucket.alias("bucket")).count().collect())
    offsets, total = [], 0
    for i in range(buckets):
        offsets.append(total)
        total += sizes.get(i, 0)
    offset = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")  # folded into one literal
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", bucket)
    window = Window.partitionBy("bucket").orderBy(*keys, *[c for c in df.columns if c not in keys])
    upto = F.sum("copies").over(window.rowsBetween(Window.unboundedPreceding, 0))
    numbered = counted.withColumn("first_number", offset[F.col("bucket").cast("int")] + upto - F.col("copies"))
    return numbered.drop("bucket"), total


def shuffle_into_shards(df: DataFrame, keys: list[str], n_shards: int, seed: int = 0) -> DataFrame:
    """All rows with `shard` and `slot`: shards of equal size (one row more at most), in an order that the seed fixes.

    The same rows get the same places however they are stored or partitioned.
    `keys` (which may be null) come first in the order of rows before it is shuffled; columns of the names shard,
    slot, copies, first_number, bucket, upto, from and place are replaced. Equal rows keep their
    number. All columns must be comparable, so no maps. An empty table stays empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards is at least 1")
    df = df.select(*[c for c in df.columns if c not in ("shard", "slot", "copies", "first_number", "bucket", "upto", "from", "place")])
    numbered, n = row_numbers(df, keys)
    # copies in runs, so that no array holds all numbers of a row that is repeated many times
    upto = F.col("first_number") + F.col("copies")
    runs = numbered.select(*df.columns, upto.alias("upto"), F.explode(F.sequence(F.col("first_number"), upto - 1, F.lit(RUN))).alias("from"))
    number = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + RUN, F.col("upto")) - 1))
    placed = runs.select(*df.columns, number.alias("place")).withColumn("place", permuted(F.col("place"), max(1, n), seed))
    return placed.select(*df.columns, (F.col("place") % n_shards).cast("int").alias("shard"), F.floor(F.col("place") / F.lit(n_shards)).cast("long").alias("slot"))
