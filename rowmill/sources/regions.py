"""Finding and reading the main table of raw grids.

Input is a long cell table (file, sheet, row, col, value): one row per cell,
rows and columns counted from 1. Sheets may hold titles, gaps and notes around
the table. All work is grouped by sheet *and* row or span, so one very long
sheet spreads over all tasks. Tables with a row per cell or sheet row are never
broadcast, whatever size the optimizer expects (it does not see how far rows are
exploded), and are shuffled into as many tasks as their cells need.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from rowmill.functions.columns import NOT_SPACE, parse_number, parse_timestamp, strip
from rowmill.plans.hot_ranges import MAX_RANGES, ROWS_PER_TASK, SOURCE_BLOCK, SOURCE_FILE, SOURCE_ROW
from rowmill.plans.lineage import materialize, written
from rowmill.sources.load import ORIGIN_FILE, ORIGIN_TABLE, _with_position

# How a header row is scored.
TEXT_WEIGHT, UNIQUE_WEIGHT, DENSITY_WEIGHT = 0.45, 0.15, 0.30
ROWS_WEIGHT, ROWS_CAP = 0.01, 10
TAG_PENALTY = 0.4
ACCEPTED_SCORE = 0.62
DENSITY_ROWS = 3
#: Rows whose places in a span are found in one task, and spans of a sheet that are matched with its rows first.
ROW_BLOCK = 4096
LEADING_SPANS = 4
#: Cells that one task groups by row, at most that many tasks, and rows of sheets or spans that every task gets whole.
CELLS_PER_TASK, MAX_TASKS = 250_000, 50_000
SENT_ROWS = 100_000

PIECE = "_piece"  # the task that read a line
START = [SOURCE_FILE, SOURCE_BLOCK, PIECE]
SHEET = ["file", "sheet"]
SPAN = [*SHEET, "start_col", "end_col"]


def _quoting(spark: SparkSession, options: dict[str, str]) -> tuple[str, str, str]:
    """Patterns for a line that ends inside a quoted cell: one that begins outside of one, and the two that begin inside."""
    given = {k.lower(): v for k, v in options.items()}
    separator = _separator(spark, options)
    quote, escape = re.escape(given.get("quote", '"') or "\0"), re.escape(given.get("escape", "\\") or "\0")
    between, first = re.escape(separator), re.escape(separator[0])
    body = f"(?:[^{quote}{escape}]++|{escape}[\\s\\S]?|{quote}{quote})*+" if escape != quote else f"(?:[^{quote}]++|{quote}{quote})*+"
    rest = f"(?:[^{first}]++|(?!{between})[\\s\\S])*+"
    closed = f"{body}{quote}(?!{quote}){rest}"
    field = f"(?:{quote}{closed}|(?!{quote}){rest})"
    return f"^(?:{field}{between})*+{quote}{body}$", f"^{body}$", f"^{closed}(?:{between}{field})*+{between}{quote}{body}$"


def _lines(spark: SparkSession, path: str | list[str], quote: str, options: dict[str, str]) -> DataFrame:
    """The lines of the files with their places, and whether a quote is open behind a line that begins outside or inside of one.

    They are written, since places are only comparable if they come from one scan. Lines
    without a quote, the most by far, are not matched.
    """
    lines = _with_position(spark.read.text(path), "text").withColumn(PIECE, F.shiftright(SOURCE_ROW, 33))
    value, opens, stays = F.col("value"), F.lit(False), F.lit(True)
    if quote:
        out, inside, again = _quoting(spark, options)
        opens = F.when(value.contains(quote), value.rlike(out)).otherwise(opens)
        stays = F.when(value.contains(quote), value.rlike(inside) | value.rlike(again)).otherwise(stays)
    return written(lines.select(*START, SOURCE_ROW, "value", opens.alias("_opens"), stays.alias("_stays")), "lines")


def _quote_before(rows: DataFrame, window: WindowSpec, opens: Column, stays: Column) -> DataFrame:
    """Whether a quote is open before each row: `_open` if `_known` or if none is open before the window, else the contrary.

    What a row does to the open quote is one of four things: leave it as it is, turn it
    round, close it, or open it. So a quote is open behind a row if the last row that
    closes or opens it leaves it so, turned by the rows since then.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum((opens & ~stays).cast("long")).over(before), F.lit(0))
    mark = F.when(opens == stays, F.struct(opens.alias("open"), F.col("_turns").alias("turns")))
    rows = rows.withColumn("_turns", turns).withColumn("_last", F.last(mark, ignorenulls=True).over(before))
    turned = (F.col("_turns") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2 == 1
    state = {"_known": F.col("_last").isNotNull(), "_open": F.coalesce(F.col("_last.open"), F.lit(False)) != turned}
    return rows.withColumns(state).drop("_turns", "_last")


def _records(lines: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(file, row, value): the records of the files in order; a line break inside a quoted cell ends none.

    Each range of `size` lines is folded by itself, for both cases of a quote before it, from
    the narrow columns. A table with one row per range tells which case holds and how many
    records there are before it; with these every line finds its record. Parsing stays Spark's.
    """
    spot, opens, stays = [*START, "_range"], F.col("_opens"), F.col("_stays")
    starts = F.broadcast(blocks.select(*START, "_first"))  # one row per split of a file
    placed = lines.join(starts, START).withColumn("_range", F.floor((F.col(SOURCE_ROW) - F.col("_first")) / size)).drop("_first")
    here = Window.partitionBy(*spot).orderBy(SOURCE_ROW)

    folded = _quote_before(placed.drop("value"), here, opens, stays)
    behind = F.when(opens == stays, opens).otherwise(F.col("_open") != (opens & ~stays))
    ends = F.struct((F.col("_known") | (opens == stays)).alias("known"), behind.alias("open"))
    begun = [F.count_if(~F.col("_open")).alias("_outside"), F.count_if(F.col("_open") != F.col("_known")).alias("_inside")]
    ranges = materialize(folded.groupBy(*spot).agg(F.max_by(ends, SOURCE_ROW).alias("_end"), *begun))
    in_file = Window.partitionBy(SOURCE_FILE).orderBy(*spot[1:])  # the ranges of one file
    ranges = _quote_before(ranges, in_file, F.col("_end.open"), F.when(F.col("_end.known"), F.col("_end.open")).otherwise(~F.col("_end.open")))
    records = F.sum(F.when(F.col("_open"), F.col("_inside")).otherwise(F.col("_outside")))
    carried = F.coalesce(records.over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = F.broadcast(ranges.select(*spot, F.col("_open").alias("_entry"), carried.alias("_carried")))  # one row per range

    rows = _quote_before(placed, here, opens, stays).join(ranges, spot)
    inside = F.when(F.col("_known"), F.col("_open")).otherwise(F.col("_open") != F.col("_entry"))
    rows = rows.withColumn("_inside", inside)
    behind = F.when(opens == stays, opens).otherwise(F.col("_inside") != (opens & ~stays))
    number = F.col("_carried") + F.sum((~F.col("_inside")).cast("long")).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"_ended": ~behind, "row": number})
    alone = ~F.col("_inside") & F.col("_ended")
    single = rows.where(alone).select(F.col(SOURCE_FILE).alias("file"), "row", "value")

    def joined(parts: DataFrame, keys: list[str], **more: Column) -> DataFrame:
        """The lines or parts of each record, in order."""
        in_order = F.transform(F.sort_array(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"])
        return parts.groupBy(*keys).agg(F.array_join(in_order, "\n").alias("value"), *[c.alias(n) for n, c in more.items()])

    # Only records that lie in several ranges are shuffled again.
    line = F.struct(SOURCE_BLOCK, SOURCE_ROW).alias("_line")
    many = rows.where(~alone).select(*spot, "row", "value", "_inside", "_ended", line)
    parts = joined(many, [*spot, "row"], _line=F.min("_line"), _whole=F.bool_or(~F.col("_inside")) & F.bool_or("_ended"))
    parts = parts.select(F.col(SOURCE_FILE).alias("file"), "row", "value", "_line", "_whole")
    whole = parts.where("_whole").select("file", "row", "value")
    return single.unionByName(whole).unionByName(joined(parts.where(~F.col("_whole")), ["file", "row"]))


def _numbered(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(file, row, value): the lines of the files in order, numbered by their places."""
    before = Window.partitionBy(SOURCE_FILE).orderBy(*START[1:]).rowsBetween(Window.unboundedPreceding, -1)  # splits of a file
    starts = blocks.select(*START, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_add"))
    rows = lines.join(F.broadcast(starts), START)  # one row per split of a file
    return rows.select(F.col(SOURCE_FILE).alias("file"), (F.col(SOURCE_ROW) + F.col("_add")).alias("row"), "value")


def cells_from_csv(
    spark: SparkSession, path: str | list[str], width: int | None = None, rows_per_task: int = ROWS_PER_TASK,
    **options: str,
) -> DataFrame:
    """Cells of headerless CSV files, one record per row; `sheet` is the file name.

    Line breaks inside quoted cells belong to the cell (a quote that is never closed takes
    the rest of its file into one cell). The lines are written once below the shared folder,
    which also tells whether any quote is open behind a line. Without a `width` a small job
    finds the most fields that any record can have.
    """
    quote = {k.lower(): v for k, v in options.items()}.get("quote", '"')
    lines = _lines(spark, path, quote, options)
    places = [F.min(SOURCE_ROW).alias("_first"), F.max(SOURCE_ROW).alias("_last"), F.count(F.lit(1)).alias("_n"), F.bool_or("_opens").alias("_opens")]
    blocks = materialize(lines.groupBy(*START).agg(*places))
    gaps = F.col("_last") - F.col("_first") + 1 != F.col("_n")  # a file that is named twice
    total, any_gap, any_open = blocks.agg(F.sum("_n"), F.bool_or(gaps), F.bool_or("_opens")).first()
    if any_open or any_gap:
        numbered = _records(lines, blocks, max(rows_per_task, math.ceil(total / MAX_RANGES)))
    else:
        numbered = _numbered(lines, blocks)
    if width is None:
        # A separator inside quotes or over another one counts too, so no record has more fields.
        separators = F.regexp_count("value", F.lit(f"(?={re.escape(_separator(spark, options))})"))
        width = 1 + (numbered.agg(F.max(separators)).first()[0] or 0)
    schema = ", ".join(f"c{i} string" for i in range(1, width + 1))
    record = F.from_csv("value", F.lit(schema), options)
    # `transform` over one element parses a record once for all columns.
    values = F.flatten(F.transform(F.array(record), lambda r: F.array(*[r[f"c{i}"] for i in range(1, width + 1)])))
    sheet = F.regexp_replace(F.url_decode(F.substring_index("file", "/", -1)), r"\.[^.]*$", "").alias("sheet")
    table = numbered.select("file", sheet, "row", values.alias("values")).select(*SHEET, "row", F.posexplode("values"))
    return table.select("file", "sheet", "row", (F.col("pos") + 1).alias("col"), F.col("col").alias("value")).filter(
        _filled(F.col("value"))
    )


def _separator(spark: SparkSession, options: dict[str, str]) -> str:
    """The separator as Spark reads it: `sep` before `delimiter`, in any case of letters, escapes resolved."""
    given = {name.lower(): value for name, value in options.items()}
    named = given.get("sep", given.get("delimiter", ","))
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.csv.CSVExprUtils.toDelimiterStr(named)


def _filled(value: Column) -> Column:
    return value.isNotNull() & value.rlike(NOT_SPACE)


def _text_like(value: Column) -> Column:
    """Words rather than a number, a date or a formula."""
    return ~value.startswith("=") & parse_number(value).isNull() & parse_timestamp(value).isNull()


def _unique_names(values: Column, start: Column) -> Column:
    """Trimmed header names, blanks as column_<n>, repeats numbered."""
    named = F.transform(
        values, lambda v, i: F.when(_filled(v), strip(v)).otherwise(F.concat(F.lit("column_"), (start + i).cast("string")))
    )

    def given(names: Column, name: Column) -> Column:
        """The names with one more: itself if free, else with the first number that neither a given nor a wanted name has."""
        options = F.transform(F.sequence(F.lit(2), F.size(named) + 2), lambda n: F.concat(name, F.lit("_"), n.cast("string")))
        free = F.filter(options, lambda o: ~F.array_contains(names, o) & ~F.array_contains(named, o))
        return F.array_append(names, F.when(F.array_contains(names, name), F.get(free, F.lit(0))).otherwise(name))

    return F.aggregate(named, F.array().cast("array<string>"), given)


def _tasks(cells: int) -> int:
    """Tasks for that many cells; a given number also keeps Spark from joining partitions that are small when compressed."""
    return max(1, min(MAX_TASKS, math.ceil(cells / CELLS_PER_TASK)))


def _sent(few: DataFrame) -> DataFrame:
    """A table of sheets or spans, to be joined with their rows: short, it goes to every task; long, it is shuffled with the rows."""
    return F.broadcast(few) if few.limit(SENT_ROWS + 1).count() <= SENT_ROWS else few.hint("merge")


def _filled_columns(cells: DataFrame) -> DataFrame:
    """The columns of the filled cells of each row, ascending."""
    return cells.groupBy(*SHEET, "row").agg(F.sort_array(F.collect_list("col")).alias("cols"))


def _inside() -> Column:
    """The filled columns of a row that lie in a span."""
    return F.filter("cols", lambda c: c.between(F.col("start_col"), F.col("end_col")))


def _header_candidates(cells: DataFrame, header_rows: int | None) -> DataFrame:
    """Runs of at least two filled cells, two of them text, that can reach the limit if the rows below are filled."""
    head = cells if header_rows is None else cells.filter(F.col("row") <= header_rows)
    in_row = Window.partitionBy(*SHEET, "row").orderBy("col")  # the cells of one row
    runs = head.withColumn("run", F.col("col") - F.row_number().over(in_row))
    grouped = runs.groupBy(*SHEET, "row", "run").agg(
        F.min("col").alias("start_col"), F.max("col").alias("end_col"), F.count(F.lit(1)).alias("width"),
        F.count_if(_text_like(F.col("value"))).alias("texts"),
        F.count_distinct(strip(F.col("value"))).alias("different"),
        F.max(strip(F.col("value")).startswith("[")).alias("tagged"),
    )
    names = (
        F.col("texts") / F.col("width") * TEXT_WEIGHT + F.col("different") / F.col("width") * UNIQUE_WEIGHT
        - F.when(F.col("tagged"), TAG_PENALTY).otherwise(0.0)
    )
    found = grouped.filter((F.col("width") >= 2) & (F.col("texts") >= 2)).withColumn("names", names)
    best = F.col("names") + DENSITY_WEIGHT + ROWS_WEIGHT * ROWS_CAP
    return found.filter(best >= ACCEPTED_SCORE - 1e-9).select(*SPAN, F.col("row").alias("header_row"), "width", "names")


def _scored(candidates: DataFrame, columns: DataFrame, tasks: int) -> DataFrame:
    """Candidates with their score but for the row bonus: names, and the share of filled cells in the rows right below."""
    last = materialize(columns.groupBy(*SHEET).agg(F.max("row").alias("last_row")))
    below = candidates.join(_sent(last), SHEET).filter(F.col("last_row") > F.col("header_row"))
    rows = F.sequence(F.col("header_row") + 1, F.least(F.col("last_row"), F.col("header_row") + DENSITY_ROWS))
    rows_below = below.select(*SPAN, "header_row", "width", "names", F.size(rows).alias("looked_at"), F.explode(rows).alias("row"))
    place = [*SHEET, "row"]
    hit = rows_below.repartition(tasks, *place).join(columns.repartition(tasks, *place).hint("merge"), place, "left")
    filled = F.sum(F.coalesce(F.size(_inside()), F.lit(0)))
    dense = hit.groupBy(*SPAN, "header_row", "width", "names", "looked_at").agg(filled.alias("filled"))
    base = F.col("names") + F.col("filled") / (F.col("width") * F.col("looked_at")) * DENSITY_WEIGHT
    # The row bonus is the only part missing; what cannot reach the limit with it is out.
    return dense.select(*SPAN, "header_row", base.alias("base")).filter(F.col("base") + ROWS_WEIGHT * ROWS_CAP >= ACCEPTED_SCORE)


def _filled_rows(spans: DataFrame, columns: DataFrame) -> DataFrame:
    """Filled rows of each span with their number in it, the row at which a table around them ends, and that row's number.

    A table ends at the first filled row that two empty ones follow. Numbers and
    ends are found inside blocks of rows and carried over from block to block, so
    that a long sheet spreads over all tasks.
    """
    rows = columns.join(_sent(spans), SHEET).filter(F.size(_inside()) > 0)
    rows = materialize(rows.select(*SPAN, "row", F.floor(F.col("row") / ROW_BLOCK).alias("block")))
    block, across = [*SPAN, "block"], Window.partitionBy(*SPAN).orderBy("block")
    up, down = Window.partitionBy(*block).orderBy("row"), Window.partitionBy(*block).orderBy(F.col("row").desc())
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*block).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.select(*block, F.lead("first").over(across).alias("next_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    joined = rows.join(blocks.hint("merge"), block)
    following = F.coalesce(F.lead("row").over(up), F.col("next_block"))
    numbered = joined.withColumns({"number": F.col("carried") + F.row_number().over(up), "following": following})
    is_end = F.col("following").isNull() | (F.col("following") > F.col("row") + 2)
    marked = materialize(numbered.select(*block, "row", "number", F.when(is_end, F.struct("row", "number")).alias("end")))
    later = Window.partitionBy(*SPAN).orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.groupBy(*block).agg(F.min("end").alias("first_end")).select(*block, F.min("first_end").over(later).alias("later_end"))
    end = F.coalesce(F.min("end").over(down), F.col("later_end"))
    found = marked.join(ends.hint("merge"), block).select(*SPAN, "row", "number", end.alias("end"))
    return found.select(*SPAN, "row", "number", F.col("end.row").alias("end_row"), F.col("end.number").alias("end_number"))


def _regions(scored: DataFrame, columns: DataFrame) -> DataFrame:
    """The accepted candidates with their end row, number of filled rows and confidence."""
    rows = _filled_rows(materialize(scored.select(*SPAN).distinct()), columns)
    ended = scored.join(rows.withColumnRenamed("row", "header_row").hint("merge"), [*SPAN, "header_row"])
    length = F.col("end_row") - F.col("header_row")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + F.least(length, F.lit(ROWS_CAP)) * ROWS_WEIGHT))
    # A header that is itself the last row has no data below it.
    accepted = ended.withColumn("score", score).filter((F.col("score") >= ACCEPTED_SCORE) & (length > 0))
    return accepted.select(
        *SPAN, "header_row", "end_row", (F.col("end_number") - F.col("number")).alias("filled_rows"), F.round("score", 3).alias("confidence")
    )


def _best_regions(scored: DataFrame, columns: DataFrame) -> DataFrame:
    """The main region of each sheet among the candidates.

    Rows of a table look like headers of narrower or later regions. The widest
    spans of a sheet are looked at first; a candidate inside one of their regions
    has fewer filled rows and no more columns, so it cannot be the main one and
    its span is not matched with the rows.
    """
    widest = Window.partitionBy(*SHEET).orderBy((F.col("end_col") - F.col("start_col")).desc(), "first", "start_col")
    spans = scored.groupBy(*SPAN).agg(F.min("header_row").alias("first"))
    leads = materialize(spans.withColumn("_rank", F.row_number().over(widest)).filter(F.col("_rank") <= LEADING_SPANS).select(*SPAN))
    sent = _sent(leads)
    led = _regions(scored.join(sent, SPAN, "left_semi"), columns)
    largest = materialize(_main(led, SPAN))
    around = largest.select(*SHEET, *[F.col(c).alias(f"lead_{c}") for c in ("start_col", "end_col", "header_row", "end_row")])
    covered = (
        (F.col("lead_start_col") <= F.col("start_col")) & (F.col("lead_end_col") >= F.col("end_col"))
        & F.col("header_row").between(F.col("lead_header_row"), F.col("lead_end_row"))
    )
    rest, around = scored.join(sent, SPAN, "left_anti"), _sent(around)
    same_sheet = (rest["file"] == around["file"]) & (rest["sheet"] == around["sheet"])
    rest = materialize(rest.join(around, same_sheet & covered, "left_anti"))
    if rest.isEmpty():
        return _main(largest, SHEET)
    return _main(largest.unionByName(_regions(rest, columns)), SHEET)


def _main(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The region with most filled cells per key; wider, higher and surer ones win ties."""
    width = F.col("end_col") - F.col("start_col") + 1
    order = [-F.col("filled_rows") * width, -width, F.col("header_row"), -F.col("confidence"), F.col("start_col")]
    place = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], "end_col", "end_row", "filled_rows", "confidence")
    best = candidates.groupBy(*keys).agg(F.min(place).alias("best"))
    return best.select(
        *SHEET, F.col("best._4").alias("start_col"), "best.end_col", F.col("best._2").alias("header_row"), "best.end_row", "best.confidence", "best.filled_rows"
    )


def _with_names(regions: DataFrame, cells: DataFrame) -> DataFrame:
    """The regions with the cells of their header row, blanks null."""
    wanted = regions.withColumn("col", F.explode(F.sequence("start_col", "end_col")))
    row = [*SHEET, "header_row"]
    heads = cells.select(*SHEET, F.col("row").alias("header_row"), "col", "value").join(_sent(regions.select(*row)), row, "left_semi")
    named = wanted.join(heads.hint("merge"), [*row, "col"], "left")
    values = F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"])
    return named.groupBy(*regions.columns).agg(values.alias("values"))


def _declared_regions(declared: DataFrame, cells: DataFrame) -> DataFrame:
    """The declared range of each sheet with most filled cells, its totals row cut off."""
    totals = F.col("has_totals") if "has_totals" in declared.columns else F.lit(False)
    ranges = declared.withColumn("end_row", F.col("end_row") - F.coalesce(totals, F.lit(False)).cast("int"))
    ranges = ranges.filter(F.col("end_row") > F.col("header_row")).select(
        *SHEET, *[F.col(n).cast("long").alias(n) for n in ("start_col", "end_col", "header_row", "end_row")]
    )
    region = [*SPAN, "header_row", "end_row"]
    rows = cells.select(*SHEET, "row", "col").join(_sent(ranges), SHEET).filter(
        F.col("col").between(F.col("start_col"), F.col("end_col"))
        & F.col("row").between(F.col("header_row") + 1, F.col("end_row"))
    )
    counts = rows.select(*region, "row").distinct().groupBy(*region).agg(F.count(F.lit(1)).alias("filled_rows"))
    counted = ranges.withColumn("confidence", F.lit(1.0)).join(counts.hint("merge"), region, "left")
    return _main(counted.withColumn("filled_rows", F.coalesce("filled_rows", F.lit(0))), SHEET)


def find_table_regions(cells: DataFrame, declared: DataFrame | None = None, header_rows: int | None = None) -> DataFrame:
    """One main table per sheet: header row, column span, end row, headers, filled rows, confidence.

    `declared` (file, sheet, header_row, start_col, end_col, end_row[, has_totals])
    wins over detection in its sheets. Headers are looked for in all rows and
    columns of a sheet, or in its first `header_rows` rows if given.
    """
    cells = cells.select(
        *SHEET, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value"
    ).filter(_filled(F.col("value")))
    free, regions = cells, None
    if declared is not None:
        regions = materialize(_declared_regions(declared, cells))
        free = cells.join(_sent(regions.select(*SHEET)), SHEET, "left_anti")
    tasks = _tasks(free.count())
    free = free.repartition(tasks, *SHEET, "row")
    columns = materialize(_filled_columns(free))
    scored = materialize(_scored(_header_candidates(free, header_rows), columns, tasks))
    found = _best_regions(scored, columns)
    result = materialize(found if regions is None else found.unionByName(regions))
    return _with_names(result, cells).select(
        *SHEET, "header_row", "start_col", "end_col", (F.col("header_row") + 1).alias("data_start_row"),
        F.col("end_row").alias("data_end_row"), _unique_names(F.col("values"), F.col("start_col")).alias("headers"),
        F.col("filled_rows").cast("long").alias("filled_rows"), "confidence",
    )


def read_region(cells: DataFrame, regions: DataFrame, headers: list[str]) -> DataFrame:
    """The cells of all regions with these headers as a table, one row per sheet row.

    Grouping by (file, sheet, row) spreads a long sheet over all tasks. The places of
    the regions are computed at once; they tell how many tasks the cells need.
    """
    same = regions.filter(F.col("headers") == F.array(*[F.lit(h) for h in headers]))
    filled = F.col("filled_rows") if "filled_rows" in regions.columns else F.col("data_end_row") - F.col("data_start_row") + 1
    sizes = (filled * (F.col("end_col") - F.col("start_col") + 1)).cast("double").alias("_cells")
    spots = materialize(same.select(*SHEET, "start_col", "end_col", "data_start_row", "data_end_row", sizes))
    tasks = _tasks(spots.agg(F.sum("_cells")).first()[0] or 0)
    inside = cells.filter(_filled(F.col("value"))).join(_sent(spots.drop("_cells")), SHEET).filter(
        F.col("row").between(F.col("data_start_row"), F.col("data_end_row"))
        & F.col("col").between(F.col("start_col"), F.col("end_col"))
    )
    place = (F.col("col") - F.col("start_col")).cast("int")
    values = [F.max(F.when(place == i, F.col("value"))).alias(h) for i, h in enumerate(headers)]
    table = inside.repartition(tasks, *SHEET, "row").groupBy(*SHEET, "row").agg(*values)
    return table.select(
        F.col("file").alias(ORIGIN_FILE), F.col("sheet").alias(ORIGIN_TABLE), F.col("row").alias(SOURCE_ROW),
        *[F.col("`" + h.replace("`", "``") + "`") for h in headers],
    )
