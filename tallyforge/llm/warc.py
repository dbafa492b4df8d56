"""Legacy archive converter: ARC files in, equivalent WARC files out, with duplicates as revisit records.

ARC comes in two versions. Both open with a version block (filedesc://) and give each record one header line that ends in the length
of what follows; the lines differ in their fields, so a line is read by the version its file declares, or by its number of fields where a file
declares none. Records are cut by declared lengths alone, never by looking for the next header.

For WARC, a record gets an identifier (a name-based UUID of its place and content), a timestamp, a type (warcinfo for version blocks, response for
HTTP, resource for the rest) and the SHA-1 of its payload. Of records with equal payloads of at least `least_bytes` that with the
largest page id is the response; the others become revisits, which hold the HTTP header only.

Archives are written and read by Spark as bytes, so a payload may be anything: images, Latin-1 pages, compressed data. A row is a run of records of about
`RUN_BYTES`, the writer's line separator ends its last record, and a file takes `RUNS_PER_FILE` rows, so no file grows with the input or nears the 2 GB that a
binary file may have when it is read. Each ARC file begins with a version block. Reading streams each file; no more than a record is held beyond the compressed
file. Payloads are shuffled once.

Defined results: a null html is an empty payload; a null page id sorts below every other and comes back null; a null or unprintable URL becomes
urn:page:<id> or is percent-encoded; html may be text (stored in UTF-8) or binary (stored as it is); repeated rows are records of their own, of which one stays a response; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.textcore import lean, scratch_dir

# The fields of both versions' header lines.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CRLF = "\r\n"

#: Bytes of records in one row, one longer record excepted, and rows of a file.
RUN_BYTES = 4 << 20
RUNS_PER_FILE = 32


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    offset: int
    version: str


def version_block(version: str, name: str, date: str) -> bytes:
    body = f"{version} 0 {'Converter'}\n{ARC_FIELDS[version]}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    if version == "2":
        head += "200 - - 0 " + name + " "
    return f"{head}{len(body)}\n".encode() + body


def arc_header(version: str, url: str, date: str, mime: str, length: int, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    if version == "1":
        return f"{url} 0.0.0.0 {date} {mime} {length}\n".encode()
    return f"{url} 0.0.0.0 {date} {mime} 200 {checksum} - {offset} {name} {length}\n".encode()


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an uncompressed ARC stream, its version blocks among them."""
    version, at = "", 0
    while line := stream.readline():
        start, at = at, at + len(line)
        if not line.strip():
            continue
        fields = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        kind = version or ("2" if len(fields) >= 10 else "1")
        if fields[0].startswith("filedesc:"):
            kind = "2" if len(fields) >= 10 else "1"
        most = len(ARC_FIELDS[kind].split())
        if len(fields) > most:  # a URL with blanks: the other fields have none
            fields = [" ".join(fields[: len(fields) - most + 1]), *fields[len(fields) - most + 1 :]]
        if len(fields) < 5 or not fields[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {start}: {line[:80]!r}")
        length = int(fields[-1])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"the ARC record at byte {start} is cut off")
        at += length
        if fields[0].startswith("filedesc:"):
            version = block[:1].decode() if block[:1] in (b"1", b"2") else kind
        yield ArcRecord(fields[0], fields[1], fields[2], fields[3], block, start, kind)


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"the WARC record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its empty line, payload); no header: all is payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_of(head: bytes) -> int | None:
    found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", head)
    return int(found[1]) if found else None


def _write(rows: DataFrame, path: str, separator: str) -> None:
    """Writes the bytes of the only column, each row followed by the separator."""
    bytes_ = F.col(rows.columns[0]).cast("string")  # the writer copies them unchanged
    rows.select(bytes_).write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", RUNS_PER_FILE).text(path)


def _grouped(records: Iterator[bytes], separator: bytes, begin: Callable[[int], bytes] = lambda row: b"") -> Iterator[pa.RecordBatch]:
    """Rows of several records, one row a batch. begin gives what the row of that number starts with."""
    row, held, size = 0, [], 0
    for record in records:
        if not held and (head := begin(row)):
            held.append(head)
            size += len(head)
        held.append(record)
        size += len(record)
        if size >= RUN_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], names=["records"])
            row, held, size = row + 1, [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([separator.join(held)], pa.binary())], names=["records"])


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """ARC files of pages (page_id, url, html), in turn of version 1 and 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version, name = "12"[part % 2], f"pages-{part:06d}.arc"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for a in range(0, batch.num_rows, 256):
                    some = batch.slice(a, 256)
                    for page, url, html in zip(*(some.column(k).to_pylist() for k in range(3))):
                        payload = html or b""
                        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page}"
                        id_line = "" if page is None else f"X-Page-Id: {page}{CRLF}"
                        head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{id_line}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
                        yield arc_header(version, url, date, "text/html", len(head) + len(payload), digest_of(payload), 0, name) + head + payload

        def first(row: int) -> bytes:
            return version_block(version, name, date) if row % RUNS_PER_FILE == 0 else b""

        yield from _grouped(records(), b"\n", first)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("binary"))
    _write(rows.mapInArrow(lean(run), "records binary"), path, "\n")


_KEY = "part string, at long, page_id long, digest string, payload_bytes long, url string, date string, record_id string, kind string"


def converted(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """A row per ARC record below the path: where it was, and its WARC fields; with payloads also head and payload."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _KEY.split(", ")] + ["head", "payload"] * payloads
        kinds = [{"string": pa.string(), "long": pa.int64()}[f.split()[1]] for f in _KEY.split(", ")] + [pa.binary()] * 2 * payloads
        for batch in batches:
            for k in range(batch.num_rows):
                part = re.sub(r"^(.*/)?(part-\d+).*?(-c\d+)?(\..*)?$", r"\2\3", batch.column(0)[k].as_py())
                stream = io.BytesIO(batch.column(1)[k].as_buffer())
                stream = gzip.GzipFile(fileobj=stream) if stream.getbuffer()[:2] == b"\x1f\x8b" else stream
                rows, size = [], 0
                for r in read_arc(io.BufferedReader(stream, 1 << 18)):
                    head, payload = payload_of(r.block)
                    digest = digest_of(payload)
                    kind = "warcinfo" if r.url.startswith("filedesc:") else "response" if head else "resource"
                    name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part} {r.offset} {r.url} {r.date} {digest}"))
                    date = f"{r.date[:4]}-{r.date[4:6]}-{r.date[6:8]}T{r.date[8:10] or '00'}:{r.date[10:12] or '00'}:{r.date[12:14] or '00'}Z"
                    row = (part, r.offset, page_of(head), digest, len(payload), r.url, date, name, kind)
                    rows.append((*row, head, payload) if payloads else row)
                    size += len(r.block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(lean(run), _KEY + ", head binary, payload binary" * payloads)


def revisits(keys: DataFrame, least_bytes: int = 0) -> DataFrame:
    """part, at and the response that each duplicate revisits."""
    alike = keys.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    best = alike.groupBy("digest", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("page_id", "part", "at", "url", "date", "record_id")).alias("r"),
    ).where(F.col("n") > 1)
    both = alike.join(best, ["digest", "payload_bytes"]).where((F.col("r.part") != F.col("part")) | (F.col("r.at") != F.col("at")))
    return both.select("part", "at", F.col("r.page_id").alias("to_page"), F.col("r.url").alias("to_url"), F.col("r.date").alias("to_date"), F.col("r.record_id").alias("to_record"))


def _warc_record(row: dict) -> bytes:
    """A WARC record; a revisit holds the HTTP header only."""
    again = row["to_record"] is not None
    block = row["head"] if again else row["head"] + row["payload"]
    content = {"warcinfo": "application/warc-fields", "response": "application/http; msgtype=response"}.get(row["kind"], "application/octet-stream")
    fields = {
        "WARC-Type": "revisit" if again else row["kind"],
        "WARC-Record-ID": f"<urn:uuid:{row['record_id']}>",
        "WARC-Date": row["date"],
        "WARC-Target-URI": None if row["kind"] == "warcinfo" else row["url"],
        "Content-Type": content,
        "WARC-Payload-Digest": f"sha1:{row['digest']}",
        "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest" if again else None,
        "WARC-Refers-To": f"<urn:uuid:{row['to_record']}>" if again else None,
        "WARC-Refers-To-Target-URI": row["to_url"],
        "WARC-Refers-To-Date": row["to_date"],
        "X-Refers-To-Page-Id": row["to_page"],
        "Content-Length": len(block),
    }
    lines = "".join(f"{name}: {value}{CRLF}" for name, value in fields.items() if value is not None)
    return f"WARC/1.0{CRLF}{lines}{CRLF}".encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Writes the WARC files that are equivalent to the ARC files."""
    links = revisits(converted(spark, arc_path, payloads=False), least_bytes)
    rows = converted(spark, arc_path, payloads=True).join(links, ["part", "at"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (_warc_record(row) for batch in batches for a in range(0, batch.num_rows, 64) for row in batch.slice(a, 64).to_pylist())
        yield from _grouped(records, (CRLF * 2).encode())

    _write(rows.mapInArrow(lean(run), "records binary"), warc_path, CRLF * 2)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id of the response and revisit records below the path.

    A response's payload is hashed again, and a record whose digest disagrees is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                stream = io.BytesIO(batch.column(0)[k].as_buffer())
                stream = gzip.GzipFile(fileobj=stream) if stream.getbuffer()[:2] == b"\x1f\x8b" else stream
                rows = []
                for fields, block in read_warc(io.BufferedReader(stream, 1 << 18)):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = payload_of(block)
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        size = len(payload)
                        if digest_of(payload) != stated:
                            raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
                    else:
                        size = int(re.search(rb"(?mi)^Content-Length: (\d+)\r?$", head)[1])
                    to = fields.get("x-refers-to-page-id")
                    rows.append((page_of(head), fields["warc-target-uri"], size, stated, kind, int(to) if to else None, fields["warc-record-id"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in schema.split(", ")])

    return files.mapInArrow(lean(run), schema)


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC files in the shared folder and back."""
    spark = pages.sparkSession
    arc, warc = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes)
    return read_archives(spark, warc)
