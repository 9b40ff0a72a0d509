"""Quality rules: base rules on text statistics, and robust multivariate outliers per language and source.

The statistics of a text are built-in array functions on its words. Four of them,
transformed, make a vector. For each language and source the minimum covariance
determinant (MCD) estimate of the vectors' centre and scatter is found by
concentration steps from two starts: keep the half of the rows with the smallest
Mahalanobis distance, estimate again. The start with the smaller determinant is
reweighted, and rows far from the centre are rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.llm.words import let, words
from rowmill.plans.lineage import written

#: Groups up to which their estimates are sent to all tasks; more are joined by a shuffle.
BROADCAST_GROUPS = 5_000
D = 4
#: Standard deviations that are taken for harmless in each coordinate, whatever a group shows.
HARMLESS = (0.06, 0.03, 0.04, 0.12)
#: Squared distance from which a row is an outlier: a thousandth of a normal sample in 4 dimensions lies beyond.
#: In a group without repetition, rows with 27 % repeated words or with repeated lines for 3 % of the words reach it.
CUTOFF = 18.5
#: Half of a normal sample in 4 dimensions shows its scatter too small by this factor; 97.5 % of it lies within NEAR.
HALF_FACTOR, NEAR, NEAR_FACTOR = 2.11, 11.14, 1.08
#: Groups of fewer rows are estimated together: first per language, then all.
MIN_ROWS = 60
STEPS = 3
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _n_repeated(w: Column) -> Column:
    """Words that lie in three-word windows found twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(o, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(o, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def width(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

        return let(ordered, lambda o: let(places(o), width))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    once = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(windows, once))


def text_statistics(text: Column) -> Column:
    """A struct of the base statistics of a whole text; a null text has zeros."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long")).alias("n_dup_lines"),
        _n_repeated(w).alias("n_repeat_words"),
    ))


def _vector() -> list[Column]:
    """Log mean word length and the square roots of the shares of symbols, repeated lines and repeated words."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]


def _join_groups(rows: DataFrame, per_group: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(per_group) if few else per_group, "g", how)


def _groups(rows: DataFrame, few: int) -> tuple[DataFrame, bool]:
    """Rows with the group `g` in which they are estimated."""
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in ("lang", "source")]
    rows = rows.withColumns({"own": F.concat_ws("\x1f", *keys), "of_lang": keys[0]})
    sizes = rows.where(~F.col("base_failed")).groupBy("own", "of_lang").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < MIN_ROWS
    rest = F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("of_lang"))
    group = F.when(~small, F.col("own")).when(rest >= MIN_ROWS, F.concat(F.lit("rest of "), F.col("of_lang"))).otherwise(F.lit("rest"))
    table = written(sizes.select("own", group.alias("g")), "groups")
    small_table = table.count() <= few
    joined = rows.join(F.broadcast(table) if small_table else table, "own", "left")
    return joined.drop("own", "of_lang"), small_table


def _distance(z: list[Column]) -> Column:
    """Squared Mahalanobis distance from the centre m0.. with the Cholesky factor l00.., by forward substitution.

    Each coordinate is used once or more in the next, so all are kept in an array.
    """
    def longer(i: int):
        def step(y: Column) -> Column:
            known = sum((F.col(f"l{i}{j}") * y[j] for j in range(1, i)), F.col(f"l{i}0") * y[0])
            return F.concat(y, F.array((z[i] - F.col(f"m{i}") - known) / F.col(f"l{i}{i}")))

        return step

    steps = F.array((z[0] - F.col("m0")) / F.col("l00"))
    for i in range(1, D):
        steps = let(steps, longer(i))
    return F.aggregate(steps, F.lit(0.0), lambda total, y: total + y * y)


def _estimate(kept: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Centre, Cholesky factor of the scatter (times `factor`, plus what is harmless) and log determinant, per group."""
    z = [F.col(f"z{i}") for i in range(D)]
    moments = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(z[i]).alias(f"m{i}") for i in range(D)],
        *[F.avg(z[i] * z[j]).alias(f"s{i}{j}") for i in range(D) for j in range(i + 1)],
    )
    names = [*keys, *[f"m{i}" for i in range(D)]]
    out = moments.select(*names, *[
        (factor * F.greatest(F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"), F.lit(0.0)) + HARMLESS[i] ** 2 if i == j else factor * (F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"))).alias(f"c{i}{j}")
        for i in range(D) for j in range(i + 1)
    ])
    for i in range(D):
        for j in range(i + 1):
            dot = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            left = F.col(f"c{i}{j}") - dot
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(HARMLESS[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, D)), F.log(F.col("l00")))
    return out.select(*names, *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], log_det.alias("log_det"))


def _quantiles(counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The bucket in which each share of a group's counts is reached."""
    order = Window.partitionBy(*keys).orderBy("bucket")
    upto = counts.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bucket"))).alias(name) for name, share in shares.items()])


def estimates(rows: DataFrame, few: bool) -> DataFrame:
    """The reweighted MCD estimate of each group `g` of rows with coordinates z0 to z3.

    Quantiles are taken on fine histograms, so that they are exact counts, the same
    in every run, and no group is sorted.
    """
    fine = 2000
    long = rows.select("g", F.posexplode(F.array(*[F.floor(F.col(f"z{i}") * fine).cast("long") for i in range(D)])).alias("i", "bucket"))
    middle = _quantiles(long.groupBy("g", "i", "bucket").agg(F.count(F.lit(1)).alias("n")), ["g", "i"], {"low": 0.25, "mid": 0.5, "high": 0.75})
    at = lambda name, i: F.max(F.when(F.col("i") == i, F.col(name)))
    spread = lambda i: F.greatest((at("high", i) - at("low", i)) / (1.349 * fine), F.lit(HARMLESS[i]))
    diagonal = {f"l{i}{j}": spread(i) if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)}
    medians = middle.groupBy("g").agg(*[((at("mid", i) + 0.5) / fine).alias(f"m{i}") for i in range(D)], *[c.alias(n) for n, c in diagonal.items()])
    names = ["g", "start", *[f"m{i}" for i in range(D)], *diagonal]
    start = medians.withColumn("start", F.lit(0)).select(names).unionByName(_estimate(rows, ["g"], 1.0).withColumn("start", F.lit(1)).select(names))
    estimate = written(start, "mcd")
    z = [F.col(f"z{i}") for i in range(D)]
    for _ in range(STEPS):
        near = _join_groups(rows, estimate, few).select("g", "start", *z, F.floor(64 * F.log2(1 + _distance(z))).cast("long").alias("bucket"))
        half = written(_quantiles(near.groupBy("g", "start", "bucket").agg(F.count(F.lit(1)).alias("n")), ["g", "start"], {"half": 0.5}), "mcd-half")
        kept = near.join(F.broadcast(half) if few else half, ["g", "start"]).where("bucket <= half")
        estimate = written(_estimate(kept, ["g", "start"], HALF_FACTOR), "mcd")
    best = Window.partitionBy("g").orderBy("log_det", "start")
    estimate = estimate.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank", "start")
    kept = _join_groups(rows, estimate, few).where(_distance(z) <= NEAR)
    return written(_estimate(kept, ["g"], NEAR_FACTOR), "mcd")


def quality_rules(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, the base statistics, base_failed, squared distance and kept, for every row of `docs`.

    base_failed: fewer than 50 words, or more than half of the words in repeated
    three-word windows. Other rows are kept unless their squared distance from
    their group's centre is above `CUTOFF`; base_failed rows are in no estimate and
    have no distance. A null text is empty, a null language or source a value of
    its own. Equal rows get equal results, an empty table none. A group of fewer
    than 60 rows is estimated with the other small groups of its language, or of all
    languages if these are too few; then however few there are. Only doc_id, text,
    lang, source and the columns in `carry` are read and returned.
    """
    carry = carry or []
    stats = docs.select("doc_id", *carry, F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text_statistics(F.col("text")).alias("s"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = written(stats.select("doc_id", *carry, "lang", "source", "s.*").withColumn("base_failed", failed), "statistics")
    grouped, few = _groups(table, BROADCAST_GROUPS)
    rows = grouped.withColumns({f"z{i}": z for i, z in enumerate(_vector())})
    found = estimates(rows.where(~F.col("base_failed")).select("g", *[f"z{i}" for i in range(D)]), few)
    judged = _join_groups(rows, found, few, "left")
    distance = F.when(~F.col("base_failed"), _distance([F.col(f"z{i}") for i in range(D)]))
    out = judged.select("doc_id", *carry, *STATISTICS, "base_failed", distance.alias("distance"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
