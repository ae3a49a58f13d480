"""ARC archives converted to WARC archives.

An ARC file begins with a version block that says how many fields its header lines have: five in
version 1 (URL, IP address, date, content type, length), ten in version 2 (result code, checksum,
location, offset and file name besides).  Each record is its header line, exactly the declared number of bytes, and a
line feed.  The converter keeps those bytes as the block of a WARC record and synthesises what
ARC lacks: a record id (a name-based UUID of URL, date, key and digest), an ISO timestamp, the record type
and SHA-1 digests of block and payload.  Equal payloads of at least ``min_bytes`` bytes are kept once:
the record with the largest key is the response, the others are revisits with its HTTP headers only.

Spark's text writer puts the files on the shared store, one archive per partition, compressed
by gzip: the line feed after an ARC record, and the two line ends after a WARC record, are its
line separators.  Files are read back whole (their size is that of a partition).  Payloads cross the network
once, by record key; hot payloads don't meet in one task, only pairs of key and digest do.

A null payload is an empty one; a null URL is written as ``-``; rows with a null key are left
out; repeated rows with equal keys and payloads are all responses of the same id; an empty table gives
no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm.common import prepare, shared_path, stored, text_or_empty

KEY, REFERS = "X-Record-Key", "X-Refers-To-Key"
DATE = "20240101000000"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
WARC_END = "\r\n\r\n"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard name space of URLs


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_block(key: int, payload: bytes) -> bytes:
    return (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{KEY}: {key}\r\n\r\n").encode() + payload


def arc_start(version: int) -> bytes:
    """The version block, without its last line feed."""
    body = f"{version} 0 pulseframe\n{FIELDS[version]}\n".encode()
    name, kind = "filedesc://archive.arc", "text/plain"
    line = f"{name} 0.0.0.0 {DATE} {kind} " + (f"{len(body)}" if version == 1 else f"200 - - 0 archive.arc {len(body)}")
    return line.encode() + b"\n" + body


def arc_record(version: int, url: str, block: bytes, offset: int, date: str = DATE) -> bytes:
    address = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") or "-"
    between = "" if version == 1 else f"200 {sha1(block)} - {offset} archive.arc "
    return f"{address} 0.0.0.0 {date} text/html {between}{len(block)}\n".encode() + block


def read_arc(data: bytes) -> Iterator[tuple[list[str], bytes]]:
    """Header fields and block of each record of an archive (plain or gzip members), by declared lengths."""
    data = plain(data)
    at, fields = 0, None
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError("header line without an end")
            return
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1
            continue
        head = line.split(" ")
        length = int(head[-1])
        block = data[end + 1:end + 1 + length]
        if len(block) < length:
            raise ValueError("record shorter than its declared length")
        at = end + 1 + length
        if fields is None:
            if not line.startswith("filedesc:"):
                raise ValueError("no version block")
            fields = {b"1": 5, b"2": 10}[block.split(None, 1)[0]]
            continue
        if len(head) < fields:
            raise ValueError("too few fields in a header line")
        # Spaces in a URL that was not encoded: the last fields are counted from the end.
        yield [" ".join(head[:len(head) - fields + 1]), *head[len(head) - fields + 1:]], block


def plain(data: bytes) -> bytes:
    """The bytes of an archive, whether compressed (as one or as many members) or not."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        inflate = zlib.decompressobj(31)
        out.append(inflate.decompress(data) + inflate.flush())
        data = inflate.unused_data.lstrip(b"\0")
    return b"".join(out)


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the empty line, and the payload after them."""
    cut = block.find(b"\r\n\r\n")
    return (block[:cut + 4], block[cut + 4:]) if block.startswith(b"HTTP/") and cut >= 0 else (b"", block)


def header(block: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", block)
    return m[1].decode("utf-8", "replace") if m else None


def warc_date(date: str) -> str:
    """ISO time of a 14-digit (or shorter) archive date."""
    d = (re.sub(r"\D", "", date) + "19700101000000"[len(re.sub(r"\D", "", date)):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_id(url: str, date: str, key: str | int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{url} {date} {key} {digest}')}>"


def warc_record(url: str, date: str, head: bytes, payload: bytes, key: int, digest: str, refers: int | None) -> bytes:
    """A response or revisit record without the two line ends that close it."""
    revisit = refers is not None
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {warc_id(url, date, key, digest)}",
             f"WARC-Date: {warc_date(date)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"{REFERS}: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Header and block of each record, by declared lengths."""
    data, at = plain(data), 0
    while True:
        at = data.find(b"WARC/1.", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at) + 4
        length = int(header(data[at:end], "Content-Length"))
        if end + length > len(data):
            raise ValueError("record shorter than its declared length")
        yield data[at:end], data[end:end + length]
        at = end + length


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 200, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def written(parts: DataFrame, path: str, separator: str) -> None:
    """One archive per partition from a binary column ``part``."""
    parts.select(F.col("part").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def write_arc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", payload: str = "html", version: int = 2) -> None:
    """Legacy archives of the given version from a table of pages."""
    prepare(pages.sparkSession)
    schema = pa.schema([("part", pa.binary())])

    def run(batches):
        def rows():
            offset = 0
            for batch in batches:
                for k, u, p in zip(*(c.to_pylist() for c in batch.columns)):
                    if not offset:
                        yield (arc_start(version),)
                        offset = len(arc_start(version)) + 1
                    record = arc_record(version, u, http_block(k, p), offset)
                    offset += len(record) + 1
                    yield (record,)
        return batches_of(rows(), schema)

    rows = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), text_or_empty(url), text_or_empty(payload).cast("binary"))
    written(rows.mapInArrow(run, "part binary"), path, "\n")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """``key, url, date, head, payload, digest, bytes`` of the records of ARC archives."""
    schema = pa.schema([("key", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("head", pa.binary()), ("payload", pa.binary()),
                        ("digest", pa.string()), ("bytes", pa.int64())])

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for fields, block in read_arc(content.as_py()):
                        head, payload = payload_of(block)
                        # A record without a key of ours gets one from its address, date and bytes.
                        k = header(head, KEY)
                        d = sha1(payload)
                        k = int(k) if k else int.from_bytes(hashlib.sha1(f"{fields[0]} {fields[2]} {d}".encode()).digest()[:8], "big", signed=True)
                        yield k, fields[0], fields[2], head, payload, d, len(payload)
        return batches_of(rows(), schema)

    return archives(spark, path).mapInArrow(run, "key long, url string, date string, head binary, payload binary, digest string, bytes long")


def convert(spark: SparkSession, arc: str, warc: str, *, min_bytes: int = 0) -> None:
    """Write the records of the ARC archives in ``arc`` as WARC archives to ``warc``."""
    prepare(spark)
    records = arc_records(spark, arc)
    names = stored(records.select("key", "digest", "bytes"), "payload-names")
    last = names.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # One key may have several payloads.
    refers = names.join(last, "digest").where("key <> last").select("key", "digest", F.col("last").alias("refers")).distinct()
    schema = pa.schema([("part", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for k, u, date, head, payload, digest, to in zip(*(c.to_pylist() for c in batch.columns)):
                    yield (warc_record(u, date, head, payload, k, digest, to),)
        return batches_of(rows(), schema)

    parts = (records.join(refers, ["key", "digest"], "left").select("key", "url", "date", "head", "payload", "digest", "refers").mapInArrow(run, "part binary"))
    written(parts, warc, WARC_END)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, type, url, date, key, payload_bytes, payload_digest, refers_to, payload`` of WARC archives; revisits have no payload."""
    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("key", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for top, block in read_warc(content.as_py()):
                        head, payload = payload_of(block)
                        kind, to = header(top, "WARC-Type"), header(top, REFERS)
                        size = int(header(head, "Content-Length"))
                        digest = header(top, "WARC-Payload-Digest").removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or sha1(payload) != digest):
                            raise ValueError("payload and its digest differ")
                        yield (header(top, "WARC-Record-ID"), kind, header(top, "WARC-Target-URI"), header(top, "WARC-Date"), int(header(head, KEY)),
                               size, digest, int(to) if to else None, payload if kind == "response" else None)
        return batches_of(rows(), schema)

    return archives(spark, path).mapInArrow(run, "record_id string, type string, url string, date string, key long, payload_bytes long, "
                                                 "payload_digest string, refers_to long, payload binary")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS b FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT)
    + 4 * CAST(b[5 * i + 3] AS INT) + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT), 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM m
"""


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a legacy archive, converted, and read back from the WARC archives."""
    path = shared_path(spark, "archives")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{path}/arc")
    convert(spark, f"{path}/arc", f"{path}/warc")
    return warc_records(spark, f"{path}/warc").select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest",
                                                      F.col("type").alias("record_type"), "refers_to")
