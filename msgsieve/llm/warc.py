"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC files read back.

ARC: a version block (``filedesc://``) names the version and the fields of the
record lines; every record is a line of these fields, the last of them its
length, and that many bytes.  The converter finds records by declared lengths
alone, whatever the bytes hold, and synthesises per record

* identifier: a UUID from the archive's name and the record's offset,
* date: the line's 14 digits (shorter ones filled up),
* type: ``warcinfo`` for version blocks, ``response`` for HTTP messages,
  ``revisit`` for a payload that an earlier page already has, else ``resource``,
* digests: SHA-256 of the payload (the HTTP body) and of the block.

Of equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the
smallest page id is the response; the others refer to it and carry their HTTP
header only.  Payloads are grouped by digest and length in an aggregate with a
map-side combine: a group of any size is a row per task, and no payload moves
for it.

WARC files are written by Spark's text writer, one archive of bounded size a
file (a larger record is an archive alone), and read through ``binaryFile``,
so any store that Spark reaches will do.

Defined cases: a null page is an empty payload.  Addresses may be null (``-``)
or hold spaces and control characters (percent-encoded).  Pages without an id
are ``-`` and come last among equal payloads.  Rows repeated with one id are
records of their own: one of them is the response.  An empty table makes no
file.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgsieve.llm.common import as_columns, scratch

ARCHIVE_BYTES = 8 << 20
LEAST_REVISIT = 100
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6f1c5f0e-2f65-5d0b-9d5e-0f2f1f3a7c11")
UNSAFE = re.compile("[\x00-\x20\x7f]")
RECORDS = "record_id string, page_id long, uri string, ip string, date string, kind string, mime string, head string, payload binary, payload_bytes long, payload_digest string"
READ = "record_id string, record_type string, page_id long, payload_bytes long, payload_digest string, refers_to_id string"


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    content: bytes


def address(url: str | None) -> str:
    """One word that stands for the address in a record line."""
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def arc_version_block(name: str, version: int, date: str) -> bytes:
    text = f"{version} 0 msgsieve\n{FIELDS[version]}\n".encode()
    extra = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(text)}\n".encode() + text + b"\n"


def arc_record(name: str, version: int, offset: int, url: str, date: str, mime: str, content: bytes) -> bytes:
    extra = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url} 127.0.0.1 {date} {mime}{extra} {len(content)}\n".encode() + content + b"\n"


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, its version block first; lines are read by the fields that the version block names."""
    at, names = 0, FIELDS[1].split()
    while at < len(data):
        if data[at:at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no record line at byte {at}")
        words = data[at:end].decode("utf-8", "replace").split(" ")
        version_block = words[0].startswith("filedesc://")
        if version_block:
            # Its own line has the fields that the block is about to name.
            length = int(words[-1])
            first, _, rest = data[end + 1:end + 1 + length].partition(b"\n")
            version = first.split(b" ")[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"ARC version {version!r}")
            names = rest.partition(b"\n")[0].decode().split()
        if len(words) != len(names):
            raise ValueError(f"{len(words)} fields at byte {at}, {len(names)} expected")
        fields = dict(zip(names, words))
        length = int(fields["Archive-length"])
        content = data[end + 1:end + 1 + length]
        if len(content) != length:
            raise ValueError(f"the record at byte {at} is cut short")
        yield ArcRecord(at, fields, content)
        at = end + 1 + length


def warc_date(digits: str) -> str:
    full = (digits + "00010101000000"[len(digits):])[:14]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def pages_as_arc(pages: DataFrame, captured: str = "20000101000000", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """name, content: archives of ``pages`` (page_id, url, html), versions 1 and 2 by turns.  Each record is the HTTP message that served the page."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, version, name = TaskContext.get().partitionId(), 0, [], 0, 1, ""

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(held)], pa.binary())], ["name", "content"])

        for batch in batches:
            ids, urls, texts = batch.columns
            for i in range(batch.num_rows):
                html = texts[i].as_buffer()
                body = b"" if html is None else html.to_pybytes()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'-' if ids[i].as_py() is None else ids[i].as_py()}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                if held and size + len(body) > archive_bytes:
                    yield out()
                    number, held, size = number + 1, [], 0
                if not held:
                    version, name = 1 + (part + number) % 2, f"pages-{part:05d}-{number:05d}.arc"
                    held.append(arc_version_block(name, version, captured))
                    size = len(held[0])
                held.append(arc_record(name, version, size, address(urls[i].as_py()), captured, "text/html", head + body))
                size += len(held[-1])
        if held:
            yield out()

    return as_columns(pages, page_id="long", url="string", html="string").mapInArrow(pack, "name string, content binary")


def record_uuid(name: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{name}#{offset}')}>"


def _number(value: bytes | None) -> int | None:
    return int(value) if value and value != b"-" else None


def header_value(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return None


def parsed_archives(archives: DataFrame) -> DataFrame:
    """A row per record of ARC archives (name, content), with what WARC wants to know of it."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                name, rows = name.as_py(), []
                for record in arc_records(content.as_buffer().to_pybytes()):
                    fields, head, payload = record.fields, b"", record.content
                    kind = "warcinfo" if fields["URL"].startswith("filedesc:") else "resource"
                    if kind == "resource" and payload.startswith(b"HTTP/"):
                        kind = "response"
                        head, gap, payload = payload.partition(b"\r\n\r\n")
                        head += gap
                    rows.append((record_uuid(name, record.offset), _number(header_value(head, b"x-page-id")), fields["URL"], fields["IP-address"], warc_date(fields["Archive-date"]), kind,
                                 fields["Content-type"], head.decode("latin-1"), payload, len(payload), hashlib.sha256(payload).hexdigest()))
                kinds = [pa.binary() if n == "payload" else pa.int64() if n in ("page_id", "payload_bytes") else pa.string() for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    return archives.select("name", "content").mapInArrow(parse, RECORDS)


def first_of_equals(records: DataFrame, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """record_id, first_id, first_uri, first_date of every record whose payload an earlier page has."""
    some = records.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)).select("record_id", "page_id", "uri", "date", "payload_bytes", "payload_digest")
    least = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "record_id", "uri", "date")).alias("first")
    groups = some.groupBy("payload_digest", "payload_bytes").agg(least, F.count(F.lit(1)).alias("copies")).where("copies > 1")
    found = some.select("record_id", "payload_digest", "payload_bytes").join(groups, ["payload_digest", "payload_bytes"]).where("record_id <> first.record_id")
    return found.select("record_id", F.col("first.record_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.date").alias("first_date"))


def warc_record(row: dict) -> bytes:
    """One record; a revisit keeps the HTTP header and leaves the payload out."""
    head = row["head"].encode("latin-1")
    kind, payload = row["kind"], row["payload"]
    if row["first_id"]:
        kind, payload = "revisit", b""
    block = head + payload
    lines = [("WARC-Type", kind), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"])]
    if kind != "warcinfo":
        lines += [("WARC-Target-URI", row["uri"]), ("WARC-IP-Address", row["ip"]), ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}")]
    if kind == "revisit":
        lines += [("WARC-Profile", PROFILE), ("WARC-Refers-To", row["first_id"]), ("WARC-Refers-To-Target-URI", row["first_uri"]), ("WARC-Refers-To-Date", row["first_date"])]
    mime = {"warcinfo": "text/plain", "resource": row["mime"]}.get(kind, "application/http; msgtype=response")
    lines += [("Content-Type", mime), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, firsts: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``records`` as WARC files, one archive a file, packed with gzip."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                held.append(warc_record({n: c[at].as_py() for n, c in zip(batch.schema.names, batch.columns)}))
                size += len(held[-1])
                if size >= archive_bytes:
                    # The writer ends a row with the line end that completes the last record.
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-2]], pa.binary())], ["value"])

    joined = records.join(firsts, "record_id", "left")
    archives = joined.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    archives.write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n").option("compression", "gzip").text(path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record of an archive, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        header = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, length = end + 4, int(header["content-length"])
        block = data[start:start + length]
        if len(block) != length or data[start + length:start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        if header.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"the record at byte {at} does not have its digest")
        yield header, block
        at = start + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response and revisit of the WARC files under ``path``; payloads are checked against their digests."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for header, block in warc_records(zlib.decompress(content.as_buffer(), 31)):
                    kind = header["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest, length = header["warc-payload-digest"].removeprefix("sha256:"), _number(header_value(head, b"content-length"))
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"{header['warc-record-id']} does not have its payload")
                    rows.append((header["warc-record-id"], kind, _number(header_value(head, b"x-page-id")), length, digest, header.get("warc-refers-to")))
                if rows:
                    kinds = [pa.int64() if n in ("page_id", "payload_bytes") else pa.string() for n in names]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)

    if not spark.read.format("binaryFile").load(path).select("path").head(1):
        return spark.createDataFrame([], READ)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ)


def convert_pages(pages: DataFrame, least_bytes: int = LEAST_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` as ARC, convert to WARC files, read these: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id."""
    spark = pages.sparkSession
    records_path, firsts_path, warc_path = (scratch(spark, f"warc-{x}") for x in ("records", "firsts", "files"))
    # Written once, so that a record keeps its identifier whatever is computed again.
    parsed_archives(pages_as_arc(pages, archive_bytes=archive_bytes)).write.option("compression", "zstd").parquet(records_path)
    records = spark.read.parquet(records_path)
    first_of_equals(records, least_bytes).write.parquet(firsts_path)
    write_warc(records, spark.read.parquet(firsts_path), warc_path, archive_bytes)
    read_path = scratch(spark, "warc-read")
    read_warc(spark, warc_path).write.parquet(read_path)
    found = spark.read.parquet(read_path)
    referred = found.select(F.col("refers_to_id")).where("refers_to_id is not null").distinct()
    targets = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).join(referred, "refers_to_id", "left_semi")
    return found.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")
