"""Exact top-k inner products with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance from it. Per pivot, the
distances are cut into rings; the rows of a ring, an annulus, are stored in blocks.
For a query q at distance d from the pivot, a vector x in an annulus [low, high] has
|q - x| >= gap = max(low - d, d - high, 0) by the triangle inequality, so its inner
product, (|q|^2 + |x|^2 - |q - x|^2) / 2, is at most (|q|^2 + most |x|^2 - gap^2) / 2.
Queries expand over their annuli from the highest bound down, and leave out every
annulus whose bound is below the k-th best score found so far. When none is left the
result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowmill.plans.lineage import written

#: Vectors that pivots are fitted on at most (those with the smallest hash of their id), and pivots at most.
PIVOT_SAMPLE, MOST_PIVOTS = 4_096, 64
#: Rows that a ring should hold, rings of a pivot at most, and rows of a block on average.
RING_ROWS, MOST_RINGS, BLOCK_ROWS = 512, 1_024, 512
#: Annuli of a query that are searched by the end of each round; the last round takes all that are left.
EXPAND = (4, 24, None)
QUERY_BATCH = 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it isn't null and holds neither nulls nor non-finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    out = np.zeros((len(column), width))
    lengths = np.asarray(pc.list_value_length(column))
    values = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def fit_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots by farthest-first traversal, moved to the rounded centres of their cells."""
    count = min(count, len(sample))
    chosen, nearest = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    for _ in range(count - 1):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen]
    for _ in range(5):
        cell = _distances(sample, pivots).argmin(axis=1)
        pivots = np.stack([np.round(sample[cell == i].mean(axis=0)) if (cell == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(0.0, squares))


def _scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; they stop at the ends of 64 bits."""
    largest = lambda m: max(1.0, float(m.max(initial=0)), -float(m.min(initial=0)))
    most = largest(queries) * largest(vectors) * queries.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(queries) @ whole(vectors).T, -(2**63), 2**63 - 1).astype(np.int64)


def build_index(vectors: DataFrame, width: int, n: int, most: float) -> tuple[DataFrame, DataFrame, dict[str, np.ndarray], np.ndarray]:
    """From rows (vec_id, v): keyed rows, blocks, the annuli's table (at most pivots times rings rows) and the pivots."""
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    pivots = fit_pivots(_matrix(sample, width), max(1, min(MOST_PIVOTS, n // 256)))

    def keyed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column("v"), width)
            distance = _distances(matrix, pivots)
            pivot = distance.argmin(axis=1)
            packed = matrix.astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(pivot, pa.int32()), pa.array(distance[np.arange(len(pivot)), pivot]), pa.array((matrix**2).sum(axis=1)), pa.array([x.tobytes() for x in packed], pa.binary())],
                ["vec_id", "pivot", "dist", "norm2", "v"],
            )

    keyed = written(vectors.mapInArrow(keyed_rows, "vec_id bigint, pivot int, dist double, norm2 double, v binary"), "keyed")
    span = keyed.groupBy("pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("n"))
    rings = F.greatest(F.lit(1), F.least(F.lit(MOST_RINGS), F.ceil(F.col("n") / RING_ROWS)))
    share = F.when(F.col("high") > F.col("low"), (F.col("dist") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))
    ring = F.least(rings - 1, F.floor(share * rings)).cast("int")
    # one row per pivot
    placed = keyed.join(F.broadcast(span), "pivot").withColumn("ring", ring).drop("low", "high", "n")
    table = placed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm2").alias("norm2"))
    found = written(table.orderBy("pivot", "ring"), "annuli").toPandas().sort_values(["pivot", "ring"])
    annuli = {c: found[c].to_numpy() for c in found}
    annuli["chunks"] = np.maximum(1, -(-annuli["n"] // BLOCK_ROWS))
    spark = vectors.sparkSession
    known = spark.createDataFrame(list(zip(range(len(found)), *(annuli[c].tolist() for c in ("pivot", "ring", "chunks")))), "annulus int, pivot int, ring int, chunks int")
    # the row's place parts equal rows too, so no block grows with a vector's copies
    chunk = F.pmod(F.xxhash64("vec_id", F.col("place")), F.col("chunks")).cast("int")
    chunked = placed.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(known), ["pivot", "ring"]).select("annulus", chunk.alias("chunk"), "vec_id", "v")

    def block(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy().astype("<i8")
        return pa.table({"annulus": table.column("annulus")[:1], "chunk": table.column("chunk")[:1], "ids": pa.array([ids.tobytes()], pa.binary()), "rows": pa.array([b"".join(table.column("v").to_pylist())], pa.binary())})

    blocks = written(chunked.groupBy("annulus", "chunk").applyInArrow(block, "annulus int, chunk int, ids binary, rows binary"), "blocks")
    return keyed, blocks, annuli, pivots


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k largest inner products of each query with all other vectors: query_id, rank (from 1), vec_id, score.

    `vectors` has vec_id and v, whole numbers as doubles (see `quantized`); rows with
    null vec_id or unusable v take no part, shorter vectors are taken as padded with
    zeros. `is_query` is a condition on vec_id. Ties go to the smaller vec_id. A query is
    no candidate of its own id. Rows that repeat a vec_id are candidates of their own
    for other queries, and one query with the vector whose bytes are largest. Fewer
    than k candidates give fewer rows, an empty table none.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    n, width, most = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    schema = "query_id bigint, vec_id bigint, score bigint"
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, most = max(1, width), most or 0.0
    keyed, blocks, annuli, pivots = build_index(rows, width, n, most)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    queries = written(
        keyed.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.max_by(F.struct("pivot", "dist", "v"), "v").alias("x")).select("query_id", "x.*")
        .repartitionByRange("pivot", "dist", "query_id").sortWithinPartitions("pivot", "dist"), "queries",
    )
    of_pivot, low, high, norm2, chunks = (annuli[c] for c in ("pivot", "low", "high", "norm2", "chunks"))
    eps = 1e-6 * (1.0 + float(norm2.max()))

    def probes(start: int, stop: int | None):
        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, QUERY_BATCH) for b in batches for at in range(0, b.num_rows, QUERY_BATCH)):
                ids, tau = batch.column("query_id").to_numpy(), batch.column("tau").to_numpy(zero_copy_only=False)
                q = np.frombuffer(b"".join(batch.column("v").to_pylist()), kind).reshape(len(ids), width)
                exact = q.astype(np.float64)
                d = _distances(exact, pivots)[:, of_pivot]
                gap = np.maximum(0.0, np.maximum(low - d, d - high))
                bound = ((exact**2).sum(axis=1)[:, None] + norm2 - gap**2) / 2
                order = np.argsort(-bound, axis=1, kind="stable")[:, start:stop]
                query = np.repeat(np.arange(len(ids)), order.shape[1])
                annulus = order.ravel()
                take = bound[query, annulus] >= tau[query] - eps
                query, annulus = query[take], annulus[take]
                by = np.argsort(annulus, kind="stable")
                query, annulus = query[by], annulus[by]
                out: dict[str, list] = {"annulus": [], "chunk": [], "query_ids": [], "q": [], "tau": []}
                for group in np.split(np.arange(len(query)), np.flatnonzero(np.diff(annulus)) + 1) if len(query) else ():
                    mine = query[group]
                    for chunk in range(int(chunks[annulus[group[0]]])):
                        out["annulus"].append(int(annulus[group[0]]))
                        out["chunk"].append(chunk)
                        out["query_ids"].append(ids[mine].astype("<i8").tobytes())
                        out["q"].append(q[mine].tobytes())
                        out["tau"].append(tau[mine].astype("<f8").tobytes())
                kinds = dict(annulus=pa.int32(), chunk=pa.int32(), query_ids=pa.binary(), q=pa.binary(), tau=pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], list(kinds))

        return wanted

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                row = {c: batch.column(c)[pair].as_py() for c in ("ids", "rows", "query_ids", "q", "tau")}
                ids, query_ids, tau = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["tau"], "<f8")
                scores = _scores(np.frombuffer(row["q"], kind).reshape(-1, width), np.frombuffer(row["rows"], kind).reshape(-1, width))
                found: list[tuple[np.ndarray, ...]] = []
                for i, query_id in enumerate(query_ids):
                    near = np.flatnonzero((scores[i] >= tau[i]) & (ids != query_id))
                    near = near[np.lexsort((ids[near], -scores[i, near]))][:k]
                    found.append((np.full(len(near), query_id), ids[near], scores[i, near]))
                columns = [np.concatenate(c) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    best, start = None, 0
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    for stop in EXPAND:
        if best is None:
            state = queries.withColumn("tau", F.lit(float("-inf")))
        else:
            kth = best.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("tau"))
            state = queries.join(kth, "query_id", "left").withColumn("tau", F.coalesce("tau", F.lit(float("-inf"))))
        pairs = state.mapInArrow(probes(start, stop), "annulus int, chunk int, query_ids binary, q binary, tau binary")
        found = pairs.join(blocks, ["annulus", "chunk"]).mapInArrow(searched, schema)
        merged = found if best is None else best.select("query_id", "vec_id", "score").unionByName(found)
        best = written(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        if stop is None or stop >= len(of_pivot):
            break
        start = stop
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
