"""Token ids in files of bit-plane shuffled, compressed chunks, and their readers.

A chunk holds a fixed number of ids (the last one of a shard fewer). Its ids, as
unsigned 32-bit integers, are transposed into 4 byte planes or 32 bit planes, and
each plane is compressed with zstandard on its own; planes of zeros take no bytes.
The payload describes itself (magic, kind of plane, number of ids, bytes of each
plane). Chunks are rows of a Parquet table, so that Spark's commit protocol guards
them when executors are lost and any store that Spark writes to will do. A second
table is the chunk index: where each chunk begins among all ids, and which
documents lie in it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowmill.llm.tokens import text_encoder, text_slices

MAGIC = b"RMBP"
CHUNKS = "shard int, chunk int, n_ids int, keys array<bigint>, lengths array<int>, continued boolean, unfinished boolean, payload binary"
DOCUMENTS = "doc_id bigint, start bigint, ids binary"


def encode_chunk(ids: np.ndarray, planes: str = "byte", level: int = 3) -> bytes:
    """The payload of one chunk: header, bytes of each plane, compressed planes."""
    import zstandard

    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        rows = octets.T
    elif planes == "bit":
        rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
    else:
        raise ValueError(f"planes are byte or bit, not {planes}")
    compressor = zstandard.ZstdCompressor(level=level)
    packed = [compressor.compress(row.tobytes()) if row.any() else b"" for row in rows]
    return MAGIC + struct.pack(f"<BI{len(packed)}I", len(packed), len(ids), *map(len, packed)) + b"".join(packed)


def decode_chunk(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    import zstandard

    if payload[:4] != MAGIC:
        raise ValueError("this is no chunk of token ids")
    count, n = struct.unpack_from("<BI", payload, 4)
    lengths = struct.unpack_from(f"<{count}I", payload, 9)
    width = n if count == 4 else -(-n // 8)
    rows, at = np.zeros((count, width), np.uint8), 9 + 4 * count
    for row, length in zip(rows, lengths):
        if length:
            row[:] = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[at : at + length], max_output_size=width), np.uint8)
        at += length
    if count == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, chunk_ids: int = 65_536, planes: str = "byte") -> None:
    """Encode the whole `text` of every document, append the end id, and write the ids in ascending `doc_id` order below `path`.

    Null texts are empty and have the end id alone. A null doc_id comes first. Rows
    with equal doc_id lie next to each other, ordered by their text's hash. Other
    columns are not read. An empty table gives files without chunks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # the row's place parts equal rows, so that a document repeated many times is spread too
    rows = rows.withColumns({"h": F.xxhash64("text"), "place": F.xxhash64(F.monotonically_increasing_id())})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place").select("doc_id", "text")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encode = TaskContext.get().partitionId(), text_encoder(tokenizer)
        writer = _ChunkWriter(shard, chunk_ids, planes)
        for batch in batches:
            for keys, texts in text_slices(batch):
                ids, counts = encode(texts)
                yield from writer.add(keys, counts + 1, np.insert(ids, np.cumsum(counts), end_id))
        yield from writer.finish()

    ordered.mapInArrow(chunks, CHUNKS).write.parquet(f"{path}/chunks")
    stored = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    per_shard = stored.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    # one row per shard, of which there are as many as partitions
    first = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("chunk")
    index = stored.select("shard", "chunk", "n_ids", "keys", F.length("payload").alias("n_bytes"), (F.sum(F.col("n_ids").cast("long")).over(within) - F.col("n_ids")).alias("at"))
    index.join(F.broadcast(first), "shard").select(
        "shard", "chunk", (F.col("shard_start") + F.col("at")).alias("first_id"), "n_ids", "n_bytes", F.element_at("keys", 1).alias("first_key"), F.element_at("keys", -1).alias("last_key"),
    ).write.parquet(f"{path}/index")


class _ChunkWriter:
    """Cuts a stream of ids into chunks and notes which documents' ids lie in each."""

    def __init__(self, shard: int, size: int, planes: str):
        self.shard, self.size, self.planes, self.chunk = shard, size, planes, 0
        self.ids: list[np.ndarray] = []
        self.keys: list = []
        self.lengths: list[int] = []
        self.held, self.continued = 0, False

    def add(self, keys: list, counts: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        for key, left in zip(keys, counts.tolist()):
            while left:
                take = min(left, self.size - self.held)
                self.keys.append(key)
                self.lengths.append(take)
                self.held += take
                left -= take
                if self.held == self.size:
                    end = at + self.size - sum(map(len, self.ids))
                    self.ids.append(ids[at:end])
                    at = end
                    yield self._row(unfinished=left > 0)
        self.ids.append(ids[at:])

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._row(unfinished=False)

    def _row(self, unfinished: bool) -> pa.RecordBatch:
        payload = encode_chunk(np.concatenate(self.ids), self.planes)
        columns = [[self.shard], [self.chunk], [self.held], [self.keys], [self.lengths], [self.continued], [unfinished], [payload]]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.bool_(), pa.binary()]
        names = ["shard", "chunk", "n_ids", "keys", "lengths", "continued", "unfinished", "payload"]
        row = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        self.chunk += 1
        self.ids, self.keys, self.lengths, self.held, self.continued = [], [], [], 0, unfinished
        return row


def read_token_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, the number of ids before it, and its ids as little-endian unsigned 32-bit integers."""
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    index = spark.read.schema("shard int, chunk int, first_id bigint").parquet(f"{path}/index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one row per shard, of which there are as many as partitions when the files were written
    shards = F.broadcast(index.where("chunk = 0").select("shard", F.col("first_id").alias("shard_start")))
    placed = chunks.join(shards, "shard").repartition(n, "shard").sortWithinPartitions("shard", "chunk")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        start = first_id = 0
        for batch in batches:
            for row in batch.to_pylist():
                first_id = row["shard_start"] if row["chunk"] == 0 else first_id
                ids = decode_chunk(row["payload"]).tobytes()
                done, at, last = [], 0, len(row["keys"]) - 1
                for i, (key, length) in enumerate(zip(row["keys"], row["lengths"])):
                    if i > 0 or not row["continued"]:
                        parts, start = [], first_id + at
                    parts.append(ids[4 * at : 4 * (at + length)])
                    at += length
                    if i < last or not row["unfinished"]:
                        done.append((key, start, b"".join(parts)))
                first_id += row["n_ids"]
                columns = zip(*done) if done else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])

    return placed.mapInArrow(documents, DOCUMENTS)
