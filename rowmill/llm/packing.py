"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Pieces are dealt at random into partitions of bounded size. Each is packed by
best-fit decreasing, and dual feasible functions give a lower bound of its number
of sequences. A partition above its bound has a gap; it gives up its loosest
sequences, and every partition gives up the loosest one, which rounding leaves
open. What they give up is dealt anew, so that partitions exchange documents, and
packed again, for as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.llm.tokens import text_encoder, text_slices
from rowmill.plans.lineage import written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Token ids of every whole text with the end id behind, in pieces of at most `capacity` ids; only the last may be shorter.

    A row per piece: doc_id, piece (from 0), start (the document's ids before it),
    length, ids_crc32 (of little-endian unsigned 32-bit ids), and on request the ids
    themselves. Null texts are empty: one piece with the end id. Rows of equal
    doc_id are documents of their own; a null doc_id stays null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer)
        for batch in batches:
            for keys, texts in text_slices(batch):
                ids, counts = encode(texts)
                octets = np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes()
                rows, parts, at = [], [], 0
                for key, n in zip(keys, (counts + 1).tolist()):
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        part = octets[4 * (at + start) : 4 * (at + start + length)]
                        rows.append((key, piece, start, length, zlib.crc32(part)))
                        if with_ids:
                            parts.append(part)
                    at += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def fewest_bins(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins that `counts[i]` items of `lengths[i]` need, by two families of dual feasible functions.

    One rounds x to floor((k + 1) x) / k and keeps multiples of 1 / (k + 1). The other
    counts items above 1 - e whole and leaves out items below e.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return 0
    best = -(-int(lengths @ counts) // capacity)
    for k in range(1, 25):
        scaled = (k + 1) * lengths
        exact = scaled % capacity == 0
        rounded, kept = int((scaled // capacity)[~exact] @ counts[~exact]), int(lengths[exact] @ counts[exact])
        best = max(best, -(-(rounded * capacity + kept * k) // (k * capacity)))
    order = np.argsort(lengths)
    sizes, many = lengths[order], counts[order]
    upto, mass = np.concatenate(([0], np.cumsum(many))), np.concatenate(([0], np.cumsum(sizes * many)))
    for least in np.unique(sizes[2 * sizes <= capacity]):
        low, high = np.searchsorted(sizes, least), np.searchsorted(sizes, capacity - least, "right")
        best = max(best, int(upto[-1] - upto[high]) - (-int(mass[high] - mass[low]) // capacity))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each item, and how full each bin is."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    with_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s is set where a bin has s left
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fitting = spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = with_space[space].pop()
            if not with_space[space]:
                spaces ^= 1 << space
        else:
            chosen, space = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = chosen, fill[chosen]
        fill[chosen] += length
        with_space[space - length].append(chosen)
        spaces |= 1 << (space - length)
    return bin_of, offset, np.array(fill, np.int64)


def _packer(columns: list[str], capacity: int, turn: int, exchange: bool):
    """The function that packs one partition; with `exchange`, it marks the pieces of the sequences it gives up."""

    def packed_part(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bin_of, offset, fill = best_fit(lengths, capacity)
        bound = fewest_bins(*np.unique(lengths, return_counts=True), capacity)
        loose = np.zeros(len(fill), bool)
        if exchange:
            loose[np.argsort(fill, kind="stable")[: 4 * (len(fill) - bound) + 1]] = True
        once = np.arange(len(lengths)) == 0
        more = {
            "sequence_id": (turn << 56) + (table.column("part").to_numpy() << 24) + bin_of, "offset": offset, "n_bins": np.where(once, len(fill), 0),
            "bound": np.where(once, bound, 0), "given_up": loose[bin_of], "n_given_up": np.where(once, int(loose.sum()), 0),
        }
        table = table.select(columns)
        for name, values in more.items():
            table = table.append_column(name, pa.array(values))
        return table

    return packed_part


def pack(pieces: DataFrame, capacity: int = 4096, part_rows: int = 50_000, rounds: int = 5) -> DataFrame:
    """The pieces with `sequence_id` and `offset`: sequences of at most `capacity`, gapless from offset 0.

    `pieces` needs a column `length` of 1 to `capacity`; a null or any other length
    is an error. Columns named sequence_id or offset are replaced; part, n_bins,
    bound, given_up and n_given_up are dropped. Equal rows are pieces of their own. An empty table stays empty. `part_rows` bounds what one
    task packs, `rounds` how often leftovers are dealt anew.
    """
    own = {"sequence_id", "offset", "part", "n_bins", "bound", "given_up", "n_given_up"}
    columns = [c for c in pieces.columns if c not in own]
    fits = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    checked = F.when(fits, F.col("length").cast("long")).otherwise(F.raise_error(F.lit(f"a length is no number from 1 to {capacity}")).cast("long"))
    left = written(pieces.select(columns).withColumn("length", checked), "pieces")
    if left.isEmpty():
        return left.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    done: list[DataFrame] = []
    before, last = None, None
    for turn in range(rounds):
        parts = max(1, -(-left.count() // part_rows))
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(parts)))

        schema = left.select(columns).schema
        for name in ("sequence_id", "offset", "n_bins", "bound"):
            schema = schema.add(name, "long")
        schema = schema.add("given_up", "boolean").add("n_given_up", "long")
        packed = written(dealt.groupBy("part").applyInArrow(_packer(columns, capacity, turn, parts > 1), schema), "packed")
        n_bins, n_given_up = packed.agg(F.sum("n_bins"), F.sum("n_given_up")).first()
        if before is not None and n_bins >= before:
            break
        done.append(packed.where(~F.col("given_up")))
        before, last = n_given_up, packed.where("given_up")
        if not n_given_up:
            last = None
            break
        left = last.select(columns)
    if last is not None:
        done.append(last)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*columns, "sequence_id", "offset")


def certificate(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """The number of sequences, and the fewest that the pieces' lengths allow. At most `capacity` counts reach the driver."""
    counts = packed.groupBy("length").count().collect()
    bins = packed.select(F.count_distinct("sequence_id")).first()[0]
    return bins, fewest_bins([r["length"] for r in counts], [r["count"] for r in counts], capacity)
