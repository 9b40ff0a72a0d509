"""WARC archives: a writer with revisit records, and a sequential reader that verifies what it reads.

Each record is one gzip member. An archive begins with a warcinfo record and ends with
a metadata record that counts the records between, so that a cut archive is noticed.
Archives are written by Spark's own text writer (a file each, so that its commit
protocol guards them on any store): the octet it adds behind a line is the archive's
last one, which is zero, as it is the high octet of the closing record's length.

The reader inflates a member piece by piece, takes the record's block by its
Content-Length, and compares the digests of block and payload on the way; no record is
held whole unless its payload is asked for.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.plans.lineage import written

#: Compressed octets after which an archive ends, and octets that are inflated at a time.
ARCHIVE_OCTETS, PIECE = 16_000_000, 65_536
#: Payloads that more than one in so many rows has are sent to all tasks: fewer than this many.
FREQUENT = 4_096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RECORDS = (
    "archive string, offset bigint, record_id string, type string, target_uri string, date string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary, fault string"
)


def digest(octets: bytes) -> str:
    return base64.b32encode(hashlib.sha1(octets).digest()).decode()


def _header(value: str) -> str:
    """A header's value without white space and control characters, which would end it."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def member(kind: str, record_id: str, content_type: str, block: bytes, date: str = DATE, **more: str | None) -> bytes:
    """One record as a gzip member; names in `more` are header names with _ for -."""
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **{n.replace("_", "-"): v for n, v in more.items() if v is not None}}
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in fields.items()) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join((deflate.compress(head.encode()), deflate.compress(block), deflate.compress(b"\r\n\r\n"), deflate.flush()))


def _page_member(row: dict, date: str) -> bytes:
    payload, url = row["payload"], row["url"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    about = {"WARC_Target_URI": None if url is None else _header(url), "WARC_Payload_Digest": f"sha1:{row['digest']}"}
    if row["first"] is None:
        return member("response", row["id"], "application/http; msgtype=response", http + payload, date, **about)
    about |= {"WARC_Refers_To": f"<{row['first']}>", "WARC_Profile": PROFILE}
    return member("revisit", row["id"], "application/http; msgtype=response", http, date, **about)


def _marked(rows: DataFrame) -> DataFrame:
    """The rows with the record id of the first row of their payload, null for first rows and for payloads too small.

    The first row is the one with the smallest key, null last; among equal keys any one.
    """
    heads = rows.where("large").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("key").isNull(), "key", "place")).alias("head"))
    name = F.concat(F.lit("urn:row:"), F.coalesce(F.col("head.key").cast("string"), F.lit("")), F.lit(":"), F.col("head.place").cast("string"))
    repeated = written(heads.where("n > 1").select("digest", "n", name.alias("first")), "payloads")
    frequent = repeated.where(F.col("n") * FREQUENT > rows.count())
    others = repeated.join(F.broadcast(frequent.select("digest")), "digest", "left_anti").select("digest", F.col("first").alias("first_of_few"))
    # frequent payloads, fewer than FREQUENT of them, are marked by broadcast; they take no part in the second join
    marked = rows.join(F.broadcast(frequent.select("digest", F.col("first").alias("first_of_many"))), "digest", "left")
    alone = F.col("first_of_many").isNotNull() | ~F.col("large")
    marked = marked.withColumn("met", F.when(alone, F.concat(F.lit("-"), F.col("place").cast("string"))).otherwise(F.col("digest")))
    marked = marked.join(others.withColumnRenamed("digest", "met"), "met", "left")
    first = F.when(F.col("large"), F.coalesce("first_of_many", "first_of_few"))
    return marked.select("id", "url", "payload", "size", F.col("digest"), F.when(first != F.col("id"), first).alias("first"))


def write_warc(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", minimum_revisit: int = 0, archive_octets: int = ARCHIVE_OCTETS, date: str = DATE,
) -> None:
    """A record for each row, in gzipped WARC files below `path`.

    The payload is the column's text in UTF-8, a null one empty. Rows whose payloads are
    equal and have at least `minimum_revisit` octets are revisits of the row with the
    smallest key (null last; of rows with equal keys, of one of them). A null url gives
    no target URI; white space and control characters in urls are percent-encoded.
    Other columns are not read. An empty table gives no archive with records.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # read twice, and places must not change in between
    rows = written(rows.withColumn("large", F.col("size") >= minimum_revisit), "pages")
    rows = rows.withColumn("id", F.concat(F.lit("urn:row:"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("place").cast("string")))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, made = f"archive-{TaskContext.get().partitionId()}", 0
        parts: list[bytes] = []
        held = count = 0

        def close() -> pa.RecordBatch:
            info = member("warcinfo", f"urn:{name}-{made}", "application/warc-fields", b"software: rowmill\r\nformat: WARC File Format 1.1\r\n", date)
            end = member("metadata", f"urn:{name}-{made}:end", "application/warc-fields", f"records: {count}\r\n".encode(), date)
            return pa.RecordBatch.from_arrays([pa.array([b"".join((info, *parts, end))[:-1]], pa.binary())], ["archive"])

        for batch in batches:
            for i in range(len(batch)):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}
                row["digest"] = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                parts.append(_page_member(row, date))
                held, count = held + len(parts[-1]), count + 1
                if held >= archive_octets:
                    yield close()
                    parts, held, count, made = [], 0, 0, made + 1
        if parts:
            yield close()

    files = _marked(rows).mapInArrow(archives, "archive binary").select(F.col("archive").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


class Damaged(ValueError):
    """A record that isn't what its headers say."""


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    payload: bytes | None
    end: int


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


class _Member:
    """The octets of one gzip member, inflated as they are taken."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.inflate, self.held = data, at, zlib.decompressobj(31), bytearray()
        self.tail = b""

    def more(self) -> bool:
        """Inflate another piece; false at the end of the member."""
        while not self.inflate.eof:
            piece = self.tail or bytes(self.data[self.at : self.at + PIECE])
            if not self.tail:
                self.at += len(piece)
            if not piece:
                raise Damaged("the archive ends within a record")
            try:
                got = self.inflate.decompress(piece, PIECE)
            except zlib.error as error:
                raise Damaged(f"the record can't be inflated: {error}") from None
            self.tail = self.inflate.unconsumed_tail
            if got:
                self.held += got
                return True
        return False

    def upto(self, mark: bytes, most: int = 1 << 20) -> bytes:
        """What comes before the mark; the mark is taken too."""
        while (found := self.held.find(mark)) < 0:
            if len(self.held) > most or not self.more():
                raise Damaged("a header doesn't end")
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n octets in pieces."""
        while n:
            if not self.held and not self.more():
                raise Damaged("the record is shorter than its Content-Length")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def read_record(data: memoryview, at: int, with_payload: bool = False) -> Record:
    """The record whose gzip member begins at a place, verified."""
    source = _Member(data, at)
    head = source.upto(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", head[0]):
        raise Damaged("this is no WARC record")
    headers = _fields(head[1:])
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("the record has no Content-Length")
    is_http = headers.get("content-type", "").startswith("application/http")
    block, payload, kept, front, n_payload = hashlib.sha1(), hashlib.sha1(), [], bytearray(), 0
    for piece in source.take(int(length)):
        block.update(piece)
        if front is not None and is_http:
            front += piece
            found = front.find(b"\r\n\r\n")
            if found < 0:
                continue
            piece, http_head, front = bytes(front[found + 4 :]), bytes(front[:found]), None
        payload.update(piece)
        n_payload += len(piece)
        if with_payload:
            kept.append(piece)
    if is_http and front is not None:
        raise Damaged("the block holds no HTTP header")
    http = _fields(http_head.decode("utf-8", "replace").split("\r\n")[1:]) if is_http else {}
    if next(source.take(4)) != b"\r\n\r\n" or source.held or source.more():
        raise Damaged("the record doesn't end behind its block")
    found = base64.b32encode(payload.digest()).decode()
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers.get("warc-type") == "revisit"
    expected = headers.get("warc-block-digest", "").removeprefix("sha1:")
    if expected and expected != base64.b32encode(block.digest()).decode():
        raise Damaged("the block doesn't have its digest")
    if stated and not revisit and stated != found:
        raise Damaged("the payload doesn't have its digest")
    size = int(http.get("content-length", "0")) if revisit else n_payload
    end = source.at - len(source.inflate.unused_data)
    return Record(headers, http, size, stated if revisit else found, b"".join(kept) if with_payload and not revisit else None, end)


def read_archive(data: bytes, closed: bool = True, with_payload: bool = False) -> Iterator[tuple[int, Record | None, str | None]]:
    """(place, record, fault) of the response, revisit and other records of an archive in order, without those that frame it.

    Behind a damaged record, reading goes on with the next gzip member. `closed` archives
    end with the record count that `write_warc` puts there.
    """
    view, at, seen, stated = memoryview(data), 0, 0, None
    while at < len(data):
        try:
            record = read_record(view, at, with_payload)
        except Damaged as fault:
            yield at, None, str(fault)
            following = data.find(b"\x1f\x8b\x08", at + 1)
            at = following if following >= 0 else len(data)
            continue
        kind = record.headers.get("warc-type")
        if closed and kind == "metadata" and record.end == len(data):
            block = read_record(view, at, with_payload=True).payload or b""
            stated = int(_fields(block.decode().split("\r\n")).get("records", "-1"))
        elif kind != "warcinfo":
            seen += 1
            yield at, record, None
        at = record.end
    if closed and stated != seen:
        yield at, None, "the archive does not hold the records it was closed with"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, closed: bool = True, on_fault: str = "raise") -> DataFrame:
    """The records of all archives below a path.

    A task reads its archives one after the other; an archive comes to it whole, so it
    must be below 2 GB (a larger one is an error). `on_fault="mark"` gives a row with a
    `fault` and null columns for each damaged record, "raise" fails. Payloads are null
    unless asked for, and for revisits, whose digest and length are those of the payload
    they refer to. `closed=False` reads archives that others wrote.
    """
    if on_fault not in ("raise", "mark"):
        raise ValueError("on_fault must be raise or mark")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))])
        for batch in batches:
            for i in range(len(batch)):
                name, rows, held = batch.column("path")[i].as_py(), [], 0
                for at, record, fault in read_archive(batch.column("content")[i].as_py(), closed, with_payload):
                    if fault is not None and on_fault == "raise":
                        raise Damaged(f"{name} at {at}: {fault}")
                    h = record.headers if record else {}
                    names = [h.get(n, "").strip("<>") or None for n in ("warc-record-id", "warc-refers-to")]
                    about = (record.payload_bytes, record.payload_digest, record.payload) if record else (None, None, None)
                    rows.append((name, at, names[0], h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), names[1], *about, fault))
                    held += len(about[2] or b"") + 300
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(records, RECORDS)


def key_of(record_id) -> object:
    """The key in a record id that `write_warc` made; null for a null key."""
    key = F.regexp_extract(record_id, r"^urn:row:(-?\d*):", 1)
    return F.when(key != "", key).cast("long")
