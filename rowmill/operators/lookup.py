"""Which cell values, or pieces of them, occur in a search text.

Both lookups count the distinct values of each column once, combined on the map
side, and match the distinct values only. Nothing limits them unless a caller
asks for it: `max_distinct` leaves out columns of many values, `limit` shortens
the list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.functions.columns import SPACE, col, is_missing, kind, strip, to_text, type_of

WORD = "[a-z0-9_]"
#: Pieces up to which they are sent to all tasks; more are dealt out with the values, over SALTS places per column.
BROADCAST_PIECES, SALTS = 50_000, 64


def _not_too_many(df: DataFrame, names: list[str], max_distinct: int) -> list[str]:
    """Columns whose distinct values are worth counting, by one sketch job.

    The sketch is off by about 5 %, so a column at the limit never comes near
    twice the limit; columns that stay are counted exactly afterwards.
    """
    sketches = [F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(names)]
    sizes = df.agg(*sketches).first()
    return [n for i, n in enumerate(names) if sizes[i] <= 2 * max_distinct + 10]


def _distinct_values(df: DataFrame, names: list[str], max_distinct: int | None, longest: int | None = None) -> DataFrame:
    """(column, raw, n, value) of all columns, or of those with at most `max_distinct` distinct raw values.

    Texts that are surely longer than `longest`, whatever white space they begin or end
    with, are left out before they are counted.
    """
    names = names if max_distinct is None else _not_too_many(df, names, max_distinct)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, raw string, n bigint, value string")
    def cell(name: str) -> Column:
        raw, wanted = to_text(df, name), ~is_missing(df, name)
        if longest is not None:
            # lower-case forms may be shorter, but not by so much
            ends = F.concat(F.substring(raw, 1, 1), F.substring(raw, -1, 1))
            wanted = wanted & ((F.length(raw) <= 3 * longest + 3) | ends.rlike(f"(?U){SPACE}"))
        return F.when(wanted, raw)

    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("column"), cell(n).alias("raw")) for n in names]))
    counted = (
        df.select(cells.alias("cell")).select("cell.*").filter(F.col("raw").isNotNull())
        .groupBy("column", "raw").agg(F.count(F.lit(1)).alias("n"))
    )
    if max_distinct is not None:
        few = counted.groupBy("column").agg(F.count(F.lit(1)).alias("distinct")).filter(F.col("distinct") <= max_distinct)
        # At most one row per column of the table.
        counted = counted.join(F.broadcast(few), "column", "left_semi")
    return counted.withColumn("value", strip(F.col("raw")))


def _after_counting(test: Column) -> Column:
    """A test that the optimizer can't move below the count of distinct values, where every cell would take it."""
    return F.when(F.monotonically_increasing_id() >= 0, test)


def _text_columns(df: DataFrame, columns: list[str] | None, texts_only: bool) -> list[str]:
    names = columns or df.columns
    return [n for n in names if kind(type_of(df, n)) in (("text",) if texts_only else ("text", "number", "boolean", "datetime"))]


def _occurs(value: Column, text: str) -> Column:
    """Whether the lower-case value stands in the text as a whole word: found, and not next to another word character."""
    words = "".join("1" if c.isascii() and (c.isalnum() or c == "_") else "0" for c in f" {text} ")
    flag = lambda place: F.substr(F.lit(words), place, F.lit(1)) == "1"

    def stands(place: Column) -> Column:
        before = value.rlike(f"^{WORD}") & flag(place)
        after = value.rlike(f"{WORD}$") & flag(place + F.length(value) + 1)
        return (F.substr(F.lit(text), place, F.length(value)) == value) & ~before & ~after

    places = F.sequence(F.lit(1), F.lit(max(1, len(text))))
    return F.lit(text).contains(value) & F.exists(places, stands)


def find_values(
    df: DataFrame, text: str, columns: list[str] | None = None, max_distinct: int | None = None, limit: int | None = None,
    minimum_length: int = 1, maximum_length: int | None = None,
) -> DataFrame:
    """Exact values of text columns that the search text names, longest first, with their row counts.

    Values shorter than `minimum_length` characters don't count as named.
    """
    names = _text_columns(df, columns, texts_only=True)
    if not names:
        raise ValueError("the table has no text column")
    # A value longer than the search text cannot stand in it.
    longest = min(len(text), maximum_length or len(text))
    values = _distinct_values(df, names, max_distinct, longest if max_distinct is None else None).withColumn("folded", F.lower("value"))
    length = F.length("folded")
    hits = values.filter(_after_counting(length.between(minimum_length, longest) & _occurs(F.col("folded"), text.strip().casefold())))
    grouped = hits.groupBy("column", "folded").agg(F.min("value").alias("value"), F.sum("n").alias("row_count"))
    ranked = grouped.orderBy(F.length("value").desc(), "column", "value")
    return (ranked if limit is None else ranked.limit(limit)).select("column", "value", "row_count")


def _shared_pieces(value: Column, text: str, minimum: int) -> Column:
    """The longest pieces of the search text that the value contains, each once; none below the minimum length.

    Pieces begin at each place of the shorter of the two and grow as long as the other
    has them, so a long search text costs a short value no more than its own length.
    """

    def longest(short: Column, size: Column, holds: Callable[[Column], Column]) -> Column:
        def reach(start: Column) -> Column:
            step = lambda best, n: F.when((best == n - 1) & holds(F.substr(short, start, n)), n).otherwise(best)
            return F.aggregate(F.sequence(F.lit(1), size - start + 1), F.lit(0), step)

        reached = F.transform(F.sequence(F.lit(1), size), lambda start: F.struct(reach(start).alias("size"), start.alias("start")))
        top = lambda found: F.array_max(F.transform(found, lambda x: x["size"]))
        best = F.transform(F.array(reached), lambda found: F.transform(F.array(top(found)), lambda n: F.filter(found, lambda x: (x["size"] == n) & (n >= minimum)))[0])[0]
        return F.array_distinct(F.transform(best, lambda x: F.substr(short, x["start"], x["size"])))

    nothing = F.array().cast("array<string>")
    if not text:
        return nothing
    by_value = longest(value, F.length(value), lambda piece: F.lit(text).contains(piece))
    by_text = longest(F.lit(text), F.lit(len(text)), lambda piece: value.contains(piece))
    return F.when(F.length(value) == 0, nothing).when(F.length(value) < len(text), by_value).otherwise(by_text)


def find_filter_candidates(
    df: DataFrame, text: str | None = None, fragments: list[str] | None = None, columns: list[str] | None = None,
    max_distinct: int | None = None, minimum_length: int = 1, limit: int | None = None, examples: int = 8,
) -> DataFrame:
    """Text filters that would match something: piece × column × ==, contains, startswith, endswith.

    Pieces are the given fragments, or the longest ones that the search text shares
    with each value, whatever their case. `value` is spelled as the column spells
    it, once per spelling, so that a filter with it finds `row_count` rows. Filters
    that select the same rows are listed once. `matched_values` are up to
    `examples` of the values that match, for display.
    """
    if (text is None) == (fragments is None):
        raise ValueError("give a search text or a list of fragments")
    names = _text_columns(df, columns, texts_only=False)
    values = _distinct_values(df, names, max_distinct).withColumn("folded", F.lower("value"))
    folded = F.col("folded")
    if fragments is not None:
        listed = [f.casefold() for f in dict.fromkeys(fragments) if len(f) >= minimum_length]
        pieces = F.filter(F.array(*[F.lit(f) for f in dict.fromkeys(listed)]).cast("array<string>"), lambda f: folded.contains(f))
    else:
        pieces = _shared_pieces(folded, text.casefold(), minimum_length)
    spelled = F.transform(pieces, lambda f: F.substr(F.col("value"), F.call_function("locate", f, folded), F.length(f)))
    wanted = values.select("column", F.explode(spelled).alias("piece")).distinct()
    if wanted.count() <= BROADCAST_PIECES:
        pairs = values.join(F.broadcast(wanted), "column")
    else:
        salt = F.pmod(F.xxhash64("raw"), F.lit(SALTS)).cast("int")
        copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = values.withColumn("salt", salt).join(copies, ["column", "salt"]).drop("salt")
    value, piece = F.col("value"), F.col("piece")
    pairs = pairs.filter(value.contains(piece))
    tests = {"==": value == piece, "contains": value.contains(piece), "startswith": value.startswith(piece),
             "endswith": value.endswith(piece)}
    counts = [F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, t in enumerate(tests.values())]
    both = F.coalesce(F.sum(F.when(tests["startswith"] & tests["endswith"], F.col("n"))), F.lit(0)).alias("both")
    counted = pairs.groupBy("column", "piece").agg(*counts, both)
    # == is within startswith and endswith, and these are within contains: equal counts mean equal rows.
    same_ends = (F.col("n2") == F.col("both")) & (F.col("n3") == F.col("both"))
    fresh = [
        F.col("n0") > 0,
        (F.col("n1") > 0) & (F.col("n1") != F.col("n0")),
        (F.col("n2") > 0) & (F.col("n2") != F.col("n0")) & (F.col("n2") != F.col("n1")),
        (F.col("n3") > 0) & (F.col("n3") != F.col("n0")) & (F.col("n3") != F.col("n1")) & ~same_ends,
    ]
    listed = F.array_compact(F.array(*[
        F.when(keep, F.struct(F.lit(i).alias("place"), F.lit(name).alias("operator"), F.col(f"n{i}").alias("row_count")))
        for i, (name, keep) in enumerate(zip(tests, fresh))
    ]))
    flat = counted.select("column", "piece", F.explode(listed).alias("c")).select("column", "piece", "c.*")
    # Examples: Spark keeps the first values of each filter before the shuffle, so none is ever collected whole.
    matching = F.explode(F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests.values())])))
    distinct = pairs.select("column", "piece", "value", matching.alias("place")).distinct()
    first = Window.partitionBy("column", "piece", "place").orderBy("value")
    few = distinct.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= examples)
    shown = few.groupBy("column", "piece", "place").agg(F.sort_array(F.collect_list("value")).alias("matched_values"))
    out = flat.join(shown, ["column", "piece", "place"], "left").select(
        "column", "operator", F.col("piece").alias("value"), "row_count", "matched_values", "place"
    )
    ranked = out.orderBy(F.length("value").desc(), "place", "column", "row_count", "value")
    return (ranked if limit is None else ranked.limit(limit)).drop("place")
