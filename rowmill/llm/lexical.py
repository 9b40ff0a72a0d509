"""Ranked lexical search: an inverted index in shards, read with Block-Max MaxScore.

Documents are cut into segments of bounded size. A segment keeps, for each term, blocks
of at most 128 postings (document and occurrences, byte-packed), each with the largest
impact in it. An impact is a posting's part of the score without the term's weight.

A segment is searched term list by term list. Lists are ordered by their bounds
(weight times the list's largest impact); those whose bounds together stay below the
score of the last place so far are not essential: documents in none of the others
cannot enter. Candidates come from essential lists; the block maxima of the other
lists then reject most of them before a block is unpacked. Each task carries its
heaps from segment to segment, and the heaps of all tasks are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text octets and documents of a segment at most (one longer document stands alone), and postings of a block.
SEGMENT_OCTETS, SEGMENT_DOCUMENTS, BLOCK = 8_000_000, 32_768, 128
#: Documents looked at first in a segment; each further step takes twice as many.
FIRST_STEP = 256
#: Octets of query texts that are searched for at a time.
QUERY_OCTETS = 4_000_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Octets of terms in UTF-8, A-Z as a-z; all others become blanks.
OCTETS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

BLOCKS = "segment bigint, term binary, block int, n int, first int, last int, best int, payload binary"
ABOUT = "ids array<bigint>, norms array<bigint>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(OCTETS).split()


class _Ids(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _packed(values: np.ndarray, widths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each value with its width in octets, low octets first, from its place on."""
    for octet in range(4):
        chosen = widths > octet
        out[at[chosen] + octet] = values[chosen] >> np.uint32(8 * octet)


def _width(largest: np.ndarray) -> np.ndarray:
    return np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))


def unpack(payload: bytes, n: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of documents, ascending, and occurrences of a block."""
    gap_width, width = payload[0] & 15, payload[0] >> 4
    kinds = {1: "<u1", 2: "<u2", 4: "<u4"}
    gaps = np.frombuffer(payload, kinds[gap_width], n, 1).astype(np.int64)
    gaps[0] = first
    return np.cumsum(gaps), np.frombuffer(payload, kinds[width], n, 1 + n * gap_width).astype(np.int64)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


@dataclass
class _Segment:
    """Documents of a segment to be; terms are numbers until it is closed."""

    number: int
    n_docs: int
    n_terms: int

    def __post_init__(self) -> None:
        self.vocabulary, self.ids, self.terms, self.octets = _Ids(), [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        self.ids.append(doc_id)
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int64, len(found)))
        self.octets += len(text)

    def full(self) -> bool:
        return self.octets >= SEGMENT_OCTETS or len(self.ids) >= SEGMENT_DOCUMENTS

    def rows(self) -> tuple[pa.RecordBatch, list, list] | None:
        """The blocks, and ids and norms of the documents in the order of their places: by doc_id, null last."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array([len(self.terms[i]) for i in order], np.int64)
        norms = 25 + (75 * lengths * self.n_docs) // max(1, self.n_terms)
        ids = [self.ids[i] for i in order]
        if not lengths.sum():
            return None
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        n = len(order)
        keys, tf = np.unique(place[np.concatenate([self.terms[i] for i in order])] * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = np.divmod(keys, n)
        impacts = impact(tf, norms[doc])
        new_term = np.flatnonzero(np.diff(term, prepend=-1))
        within = np.arange(len(term)) - np.repeat(new_term, np.diff(new_term, append=len(term)))
        starts = np.flatnonzero(within % BLOCK == 0)
        sizes = np.diff(starts, append=len(term))
        block = np.repeat(np.arange(len(starts)), sizes)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = 0
        gap_width, width = _width(np.maximum.reduceat(gaps, starts)), _width(np.maximum.reduceat(tf, starts))
        lengths_of = 1 + sizes * (gap_width + width)
        offsets = np.concatenate(([0], np.cumsum(lengths_of)))
        out = np.zeros(offsets[-1], np.uint8)
        out[offsets[:-1]] = gap_width | width << 4
        inside = within % BLOCK
        _packed(gaps.astype(np.uint32), gap_width[block], offsets[block] + 1 + inside * gap_width[block], out)
        _packed(tf.astype(np.uint32), width[block], offsets[block] + 1 + sizes[block] * gap_width[block] + inside * width[block], out)
        payload = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
        columns = [
            pa.array(np.full(len(starts), self.number, np.int64)), pa.array(names, pa.binary()).take(pa.array(term[starts])), pa.array((within[starts] // BLOCK).astype(np.int32)),
            pa.array(sizes.astype(np.int32)), pa.array(doc[starts].astype(np.int32)), pa.array(doc[starts + sizes - 1].astype(np.int32)),
            pa.array(np.maximum.reduceat(impacts, starts).astype(np.int32)), payload,
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in BLOCKS.split(", ")]), ids, norms.tolist()


def build_index(docs: DataFrame, path: str) -> None:
    """Index every whole `text` of the documents below `path`: the tables `index` and `corpus`.

    Null and empty texts, and texts without terms, are indexed as documents that
    nothing finds; they do not count in N. Repeated rows are documents of their own.
    A null doc_id sorts behind all others. Other columns are not read; an empty table
    gives an empty index.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    count = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(TERM)), F.lit(0)).cast("long")
    corpus = rows.select(count.alias("n")).agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms"))
    n_docs, n_terms = corpus.first()
    spark.range(1).select(F.lit(n_docs).alias("n_docs"), F.lit(n_terms).alias("n_terms")).write.parquet(f"{path}/corpus")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        segment = _Segment(first, n_docs, n_terms)

        def close() -> Iterator[pa.RecordBatch]:
            made = segment.rows()
            if made is not None:
                blocks, ids, norms = made
                empty = pa.nulls(len(blocks), pa.list_(pa.int64()))
                for a in range(0, len(blocks), 20_000):
                    part = blocks.slice(a, 20_000)
                    yield pa.RecordBatch.from_arrays([*part.columns, empty[: len(part)], empty[: len(part)]], [*part.schema.names, "ids", "norms"])
                nothing = [pa.nulls(1, f.type) for f in blocks.schema][1:]
                about = [pa.array([ids], pa.list_(pa.int64())), pa.array([norms], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array([segment.number], pa.int64()), *nothing, *about], [*blocks.schema.names, "ids", "norms"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                segment.add(doc_id.as_py(), text.as_py() or b"")
                if segment.full():
                    yield from close()
                    segment = _Segment(segment.number + 1, n_docs, n_terms)
        yield from close()

    made = rows.mapInArrow(indexed, f"{BLOCKS}, {ABOUT}")
    made.write.parquet(f"{path}/index")  # rows about a segment have no term


class _List:
    """A term's blocks in one segment; a block is unpacked when it is first needed."""

    def __init__(self, rows: list[dict], norms: np.ndarray):
        rows.sort(key=lambda r: r["block"])
        self.rows, self.norms = rows, norms
        self.firsts = np.array([r["first"] for r in rows], np.int64)
        self.lasts = np.array([r["last"] for r in rows], np.int64)
        self.bests = np.array([r["best"] for r in rows], np.int64)
        self.best = int(self.bests.max())
        self.unpacked: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(rows)

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if self.unpacked[i] is None:
            row = self.rows[i]
            docs, tf = unpack(row["payload"], row["n"], row["first"])
            self.unpacked[i] = docs, impact(tf, self.norms[docs])
        return self.unpacked[i]

    def between(self, a: int, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts from a up to before z."""
        i, j = int(np.searchsorted(self.lasts, a)), int(np.searchsorted(self.firsts, z))
        parts = [self.block(b) for b in range(i, j)]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        docs, impacts = (parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts))))
        x, y = np.searchsorted(docs, (a, z))
        return docs[x:y], impacts[x:y]

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that each document would be in, and its largest impact (0 between blocks)."""
        at = np.minimum(np.searchsorted(self.lasts, docs), len(self.lasts) - 1)
        return at, np.where((self.firsts[at] <= docs) & (docs <= self.lasts[at]), self.bests[at], 0)


def search_segment(
    lists: list[tuple[int, _List]], ids: list, top: list[tuple[int, bool, int]], k: int, n_docs: int, counters: Counter | None = None,
) -> list[tuple[int, bool, int]]:
    """The k best of `top` and the segment's documents, as (-score, doc_id is null, doc_id), by weighted lists."""
    counters = Counter() if counters is None else counters
    lists = sorted(((w, entry) for w, entry in lists if w > 0), key=lambda p: p[0] * p[1].best)
    bounds = np.cumsum([w * entry.best for w, entry in lists]) if lists else np.empty(0, np.int64)
    a, step = 0, FIRST_STEP
    while a < n_docs and lists:
        z, step = min(n_docs, a + step), step * 2
        # a document ties with the last place at best if it only reaches its score; then the smaller doc_id decides
        least = -top[-1][0] if len(top) == k else 1
        essential = int(np.searchsorted(bounds, least))
        if essential == len(lists):
            counters["segments_left"] += 1
            break
        scores = np.zeros(z - a, np.int64)
        for w, entry in lists[essential:]:
            docs, impacts = entry.between(a, z)
            scores[docs - a] += w * impacts
        found = np.flatnonzero(scores)
        found = found[scores[found] + (bounds[essential - 1] if essential else 0) >= least]
        total = scores[found]
        if essential and len(found):
            where = [(w, entry, *entry.bounds(found + a)) for w, entry in lists[:essential]]
            rest = sum(w * best for w, _, _, best in where)
            counters["candidates"] += len(found)
            for i in reversed(range(essential)):
                keep = total + rest >= least
                if not keep.all():
                    found, total, rest = found[keep], total[keep], rest[keep]
                    where = [(w, entry, at[keep], best[keep]) for w, entry, at, best in where]
                if not len(found):
                    break
                w, entry, at, best = where.pop()
                rest = rest - w * best
                possible = best > 0
                for b in np.unique(at[possible]).tolist():
                    docs, impacts = entry.block(b)
                    mine = np.flatnonzero(possible & (at == b))
                    place = np.minimum(np.searchsorted(docs, found[mine] + a), len(docs) - 1)
                    hit = docs[place] == found[mine] + a
                    total[mine[hit]] += w * impacts[place[hit]]
            counters["survivors"] += len(found)
        good = found[total >= least]
        total = total[total >= least]
        if len(good) > k:
            # places ascend with doc_id, so a stable order by score keeps ties right
            best = np.argsort(-total, kind="stable")[:k]
            good, total = good[best], total[best]
        new = [(-int(s), ids[d + a] is None, ids[d + a] or 0) for d, s in zip(good.tolist(), total.tolist())]
        if new:
            top = sorted(top + new)[:k]
        a = z
    return top


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of `queries` the k documents with the highest scores above 0.

    Equal scores go by ascending doc_id, null last. A null text, or one without terms,
    finds nothing; rows with one item_id are ranked each on their own. Queries are
    searched in blocks of about `QUERY_OCTETS` octets of text, whose terms are sent to
    all tasks; the documents are never gathered.
    """
    asked = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") > 0)
    octets = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(octets / QUERY_OCTETS))
    n_docs = spark.read.schema("n_docs bigint").parquet(f"{path}/corpus").first()[0]
    out = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()  # about QUERY_OCTETS
        found = _search_block(spark, path, [(r["item_id"], Counter(terms_of(bytes(r["text"])))) for r in rows], k, n_docs)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark: SparkSession, path: str, asked: list[tuple[int | None, Counter]], k: int, n_docs: int) -> DataFrame:
    terms = sorted({t for _, counts in asked for t in counts})
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term binary"))  # at most the octets of a block of queries
    index = spark.read.schema(f"{BLOCKS}, {ABOUT}").parquet(f"{path}/index")
    blocks = index.join(wanted, "term", "left_semi")
    df = {bytes(r["term"]): r["df"] for r in blocks.groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df")).collect()}  # a row per term of the queries
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    weighted = [[(t, c * weights[t]) for t, c in counts.items() if t in weights] for _, counts in asked]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = blocks.unionByName(index.where(F.col("term").isNull()))
    shards = mixed.repartition(n, "segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first())

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: list[list[tuple[int, bool, int]]] = [[] for _ in weighted]
        about: dict | None = None
        held: dict[bytes, list[dict]] = {}

        def close() -> None:
            if about is None:
                return
            norms = np.array(about["norms"], np.int64)
            lists = {term: _List(rows, norms) for term, rows in held.items()}
            for i, asked_terms in enumerate(weighted):
                mine = [(w, lists[t]) for t, w in asked_terms if t in lists]
                if mine:
                    tops[i] = search_segment(mine, about["ids"], tops[i], k, len(norms))

        for batch in batches:
            for row in batch.to_pylist():
                if row["term"] is None:
                    close()
                    about, held = row, {}
                else:
                    held.setdefault(row["term"], []).append(row)
        close()
        flat = [(i, s, null, d) for i, top in enumerate(tops) for s, null, d in top]
        columns = zip(*flat) if flat else ((), (), (), ())
        query, less, null, doc = columns
        arrays = [pa.array(query, pa.int32()), pa.array([-s for s in less], pa.int64()), pa.array([None if m else d for m, d in zip(null, doc)], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["query", "score", "doc_id"])

    heaps = shards.mapInArrow(searched, "query int, score bigint, doc_id bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    merged = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "query int, item_id bigint"))
    return merged.join(names, "query").select("item_id", "rank", "doc_id", "score")
