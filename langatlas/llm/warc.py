"""WARC archives as a chunked record table.

Writing: every page is a record; a block longer than ``chunk_bytes`` is written
as WARC segments (the first record and its continuations), so a chunk row --
record id, chunk number, bytes -- is all that is ever one value.  Spark's text
writer puts the chunk rows into gzip files; a task writes a page's segments one
after the other.

Reading: a gzip file is read by one task from start to end.  The parser takes
the bytes as they come, gives the payload out chunk by chunk and carries the
SHA-1 along; no record is held as a whole.  The last chunk of a record has the
length and digest of the full payload.

Of records with equal payloads the one with the largest id is the response and
the others are revisits of it (identical-payload-digest profile).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from langatlas.llm.common import stage, text_slices

CHUNK_BYTES = 32 << 10
MIN_REVISIT_BYTES = 0
BREAK = b"\r\n\r\n"
# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
NULL_ID = "null:"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
#: Bytes of one output batch.
BATCH_BYTES = 4 << 20


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def cut_utf8(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes (4 at least) that end between characters."""
    pieces, at = [], 0
    while len(data) - at > size:
        end = at + size
        while data[end] & 0xC0 == 0x80:
            end -= 1
        pieces.append(data[at:end])
        at = end
    return [*pieces, data[at:]]


def _urn(record_id: str) -> str:
    return f"<{RECORD_URN}{record_id}>"


def record_chunks(page_id: str, url: str | None, payload: bytes, digest: str,
                  refers_to: str | None, date: str, chunk_bytes: int) -> Iterator[str]:
    """The record of a page as WARC records, without their last line break."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit")]
    if url is not None:
        headers.append(("WARC-Target-URI", UNSAFE.sub(lambda m: quote(m[0]), url)))
    headers += [("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", REVISIT_PROFILE)]
    blocks = [b""] if refers_to is not None else cut_utf8(payload, chunk_bytes)
    blocks[0] = http + blocks[0]
    total = sum(map(len, blocks))
    for number, block in enumerate(blocks, 1):
        record_id = page_id if number == 1 else f"{page_id}:{number}"
        if number > 1:
            headers = [("WARC-Type", "continuation"), ("WARC-Date", date),
                       ("WARC-Segment-Origin-ID", _urn(page_id))]
        own = [*headers, ("WARC-Record-ID", _urn(record_id))]
        if len(blocks) > 1:
            own.append(("WARC-Segment-Number", str(number)))
        if number == len(blocks) > 1:
            own.append(("WARC-Segment-Total-Length", str(total)))
        own.append(("Content-Length", str(len(block))))
        yield f"{VERSION}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own) + "\r\n" + block.decode()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES,
               chunk_bytes: int = CHUNK_BYTES) -> None:
    """Write a record per row under ``path`` (a folder of .gz files).

    A null payload is empty.  Payloads shorter than ``min_revisit_bytes`` are
    always responses.  A null id has a record of its own that no revisit names;
    it is a revisit if a page with an id has its payload.  Rows that repeat the
    id of the response are responses too.  A null url is left out.  An empty
    table writes no record.
    """
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    responses = stage(rows.where(F.octet_length("payload") >= min_revisit_bytes)
                      .groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("n"))
                      .where("n > 1").select(F.col("digest").alias("of"), "first"), "warc-responses")
    named = rows.join(responses, F.col("digest") == F.col("of"), "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "digest",
        F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
        .alias("refers_to"), F.monotonically_increasing_id().alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for part in text_slices(batch, "payload"):
                for page_id, url, text, digest, refers_to, number in zip(
                        *(c.to_pylist() for c in part.columns)):
                    name = f"{NULL_ID}{number}" if page_id is None else quote(page_id, safe="")
                    first = None if refers_to is None else quote(refers_to, safe="")
                    for chunk in record_chunks(name, url, text.encode(), base32_sha1(digest),
                                               first, date, chunk_bytes):
                        out.append(chunk)
                        held += len(chunk)
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                            out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (named.mapInArrow(run, "value string")
     .write.option("compression", "gzip").option("lineSep", BREAK.decode()).text(path))


class ChunkParser:
    """Bytes of one archive, as they come -> chunk rows
    ``(record_id, chunk, record_type, refers_to, payload, length, digest)``;
    ``length`` and ``digest`` are those of the full payload on the last chunk
    and null on the others."""

    def __init__(self) -> None:
        self.held = b""
        self.left = -1                       # bytes of the block and its end; -1: in headers
        self.headers: dict[str, str] = {}
        self.origin: dict | None = None      # the record whose segments are being read

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.held += data
        while True:
            if self.left < 0:
                head, found, rest = self.held.partition(BREAK)
                if not found:
                    return
                if not head:          # after the last record: the break the reader adds
                    self.held = rest
                    continue
                lines = head.decode().split("\r\n")
                if lines[0] != VERSION:
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                self.headers = dict(line.split(": ", 1) for line in lines[1:])
                self.held, self.left = rest, int(self.headers["Content-Length"]) + len(BREAK)
            if len(self.held) < self.left:
                return
            block, self.held = self.held[:self.left - len(BREAK)], self.held[self.left:]
            self.left = -1
            yield self._segment(block)

    def _segment(self, block: bytes) -> tuple:
        h = self.headers
        number = int(h.get("WARC-Segment-Number", 1))
        if number == 1:
            http, _, block = block.partition(BREAK)
            told = re.search(rb"^Content-Length: (\d+)", http, re.M)
            self.origin = {"id": h["WARC-Record-ID"][1:-1].removeprefix(RECORD_URN),
                           "type": h["WARC-Type"], "sha1": hashlib.sha1(), "bytes": 0, "chunk": 0,
                           "told": int(told[1]), "digest": h["WARC-Payload-Digest"].split(":")[1],
                           "refers_to": h.get("WARC-Refers-To", "")[1:-1].removeprefix(RECORD_URN)}
        o = self.origin
        if o is None or number != o["chunk"] + 1:
            raise ValueError(f"segment {number} of {h.get('WARC-Segment-Origin-ID')} out of order")
        o["chunk"] = number
        o["sha1"].update(block)
        o["bytes"] += len(block)
        length = digest = None
        if "WARC-Segment-Number" not in h or "WARC-Segment-Total-Length" in h:
            length, digest = o["told"], o["digest"]
            read = base64.b32encode(o["sha1"].digest()).decode()
            if o["type"] != "revisit" and (length, digest) != (o["bytes"], read):
                raise ValueError(f"payload of {o['id']} differs from its headers")
            self.origin = None
        record_id = None if o["id"].startswith(NULL_ID) else unquote(o["id"])
        return (record_id, number - 1, o["type"], unquote(o["refers_to"]) or None, block,
                length, digest)


def read_warc_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of all archives under ``path``."""
    schema = ("record_id string, chunk int, record_type string, refers_to string, "
              "payload binary, payload_bytes bigint, payload_digest string")
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, parser = None, ChunkParser()
        for batch in batches:
            out, held = [], 0
            for value, name in zip(batch.column("value"), batch.column("file").to_pylist()):
                if name != file:
                    file, parser = name, ChunkParser()
                for row in parser.feed(value.as_buffer().to_pybytes() + BREAK):
                    out.append(row)
                    held += len(row[4])
                if held >= BATCH_BYTES:
                    yield batch_of(out)
                    out, held = [], 0
            if out:
                yield batch_of(out)

    lines = (spark.read.option("lineSep", BREAK.decode()).schema("value string").text(path)
             .select("value", F.input_file_name().alias("file")))
    return lines.mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Per record ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    return (read_warc_chunks(spark, path).where("payload_digest IS NOT NULL")
            .select(F.col("record_id").cast(id_type).alias("page_id"), "payload_bytes",
                    "payload_digest", "record_type", F.col("refers_to").cast(id_type)
                    .alias("refers_to")))
