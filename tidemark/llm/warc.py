"""Legacy ARC archives converted to WARC.

``parse_arc`` reads version 1 and 2 ARC files (plain or gzip): the version block names the header's fields,
each record's header line is split by them, and its declared length delimits the record. ``warc_record``
makes the equivalent WARC/1.0 record: identifier, ISO timestamp, type, block and payload digests. Of records
with equal payloads of MIN_REVISIT bytes or more, the one with the smallest id stays a response and the
others become revisits that refer to it and leave the payload out. ``write_warc`` stores archives
with Spark's own committer (so a lost executor leaves no half file), ``read_warc`` reads them by declared
lengths.

Archives are gzip files of whole records, of FILE_BYTES at most before packing (a longer record stands alone). Only
(digest, id) pairs meet for the grouping, summed before they are shuffled; the table of repeated payloads is
broadcast only if it was counted and is small, else joined with the skewed side split.

Defined cases: null html is an empty payload, stored as a response; null url is ``urn:page:<id>``; a null
id is left empty and never the first of a group; rows that share an id and payload are all responses if
theirs is the smallest id; spaces in urls are percent-encoded; damaged ARC files give a row with the error; empty
tables give archives without records; extra columns are left out.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, hint_if_small, small_batches

MIN_REVISIT, FILE_BYTES = 100, 32 << 20
END = "\r\n\r\n"
# The header fields of both ARC versions.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
EPOCH = datetime.datetime(2008, 1, 1)


class ArcRecord(NamedTuple):
    version: int
    offset: int
    fields: dict[str, str]
    block: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def arc_file(name: str, version: int, records: list[tuple[str, str, str, str, int, bytes]]) -> bytes:
    """An ARC file of (url, ip, 14-digit date, type, result code, block) records."""
    body = f"{version} 0 tidemark\n{FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 -" if version == 2 else ""
    out = [f"filedesc://{name} 0.0.0.0 {EPOCH:%Y%m%d%H%M%S} text/plain{extra} {len(body)}\n".encode(), body, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, code, block in records:
        middle = f" {code} {hashlib.md5(block).hexdigest()} - {at} {name}" if version == 2 else ""
        out += [f"{url} {ip} {date} {kind}{middle} {len(block)}\n".encode(), block, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, names, version = 0, None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        start, stop = at, data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"a header without end at {at}")
        parts = data[at:stop].decode("utf-8", "replace").rstrip("\r").split(" ")
        if names is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("no version block")
            length = int(parts[-1])
            lines = data[stop + 1 : stop + 1 + length].decode("utf-8", "replace").split("\n")
            version, names = int(lines[0].split(" ")[0]), lines[1].strip().split(" ")
            if FIELDS.get(version) != " ".join(names):
                raise ValueError(f"unknown version {lines[0]!r}")
        else:
            if len(parts) != len(names):
                raise ValueError(f"{len(parts)} header fields at {at}")
            fields = dict(zip(names, parts, strict=True))
            length = int(fields["Archive-length"])
            if stop + 1 + length > len(data):
                raise ValueError(f"a record beyond the file's end at {at}")
            yield ArcRecord(version, start, fields, data[stop + 1 : stop + 1 + length])
        at = stop + 1 + length


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its empty line) and body of an HTTP message; no head where there is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(END.encode())
    return (block, b"") if cut < 0 else (block[: cut + 4], block[cut + 4 :])


def http_header(head: bytes, name: str) -> str | None:
    want = name.lower().encode() + b":"
    return next((x[len(want) :].strip().decode("utf-8", "replace") for x in head.split(b"\r\n") if x[: len(want)].lower() == want), None)


def record_id(key: int | None, name: str) -> str:
    """A UUID: version 8 with a numeric key's 64 bits in it, so that references can be read back; else version 5 of the name."""
    if key is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"
    k, h = key & (1 << 64) - 1, int.from_bytes(hashlib.sha256(name.encode()).digest()[:8]) >> 6
    return f"<urn:uuid:{uuid.UUID(int=(k >> 16) << 80 | 8 << 76 | (k >> 4 & 0xFFF) << 64 | 2 << 62 | (k & 15) << 58 | h)}>"


def key_of(identifier: str) -> int | None:
    u = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:"))
    if u.version != 8:
        return None
    k = (u.int >> 80) << 16 | (u.int >> 64 & 0xFFF) << 4 | u.int >> 58 & 15
    return k - (1 << 64) if k >> 63 else k


def iso_date(arc_date: str) -> str:
    return f"{datetime.datetime.strptime(arc_date.ljust(14, '0')[:14], '%Y%m%d%H%M%S'):%Y-%m-%dT%H:%M:%SZ}"


def warc_record(url: str, ip: str, arc_date: str, kind: str, block: bytes, key: int | None, refers_to: int | None = None, refers_name: str = "") -> bytes:
    """The WARC record of an ARC one, without the two line ends that follow it."""
    head, payload = http_parts(block)
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    stored = head if revisit else block
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response' if head else 'resource'}",
        f"WARC-Record-ID: {record_id(key, f'{url} {arc_date}')}",
        f"WARC-Date: {iso_date(arc_date)}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(stored).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to, refers_name)}", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else kind}", f"Content-Length: {len(stored)}"]
    return "\r\n".join(lines).encode() + END.encode() + stored


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, by their declared lengths."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        stop = data.find(END.encode(), at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
        n = int(headers["Content-Length"])
        yield WarcRecord(headers, data[stop + 4 : stop + 4 + n])
        at = stop + 4 + n + 4


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=[n for n, _ in kinds])


def legacy_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as ARC files (archive, content) of some megabytes, versions by turns: the input of the converter where a corpus has no archives of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2, 4 << 20):
            records, first = [], None
            for key, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                body, first = html or b"", key if first is None else first
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                date = EPOCH + datetime.timedelta(seconds=(key or 0) % (10**8))
                where = "%20".join((url or f"urn:page:{key}").split()) or f"urn:page:{key}"
                records.append((where, "0.0.0.0", f"{date:%Y%m%d%H%M%S}", "text/html", 200, head + body))
            if records:
                name = f"pages-{first}.arc"
                yield _batch([(name, arc_file(name, 1 + (first or 0) % 2, records))], [("archive", pa.string()), ("content", pa.binary())])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "archive string, content binary")


def arc_records(archives: DataFrame) -> DataFrame:
    """One row per record of ARC files (archive, content): id (from X-Page-Id, else null), url, ip, date, kind, block, payload_bytes, digest, archive, error.

    A damaged file gives its records up to the damage and then a row that has archive and error alone; the others go on."""
    kinds = [("id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("archive", pa.string()), ("error", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                try:
                    for r in parse_arc(content.as_py() or b""):
                        head, payload = http_parts(r.block)
                        key = http_header(head, "X-Page-Id")
                        rows.append((int(key) if key and re.fullmatch(r"-?\d{1,19}", key) and -(1 << 63) <= int(key) < 1 << 63 else None, r.fields["URL"], r.fields["IP-address"], r.fields["Archive-date"], r.fields["Content-type"], r.block, len(payload), hashlib.sha256(payload).hexdigest(), name, None))
                except (ValueError, OSError, EOFError, zlib.error) as e:
                    rows.append((*[None] * 8, name, str(e)))
                yield _batch(rows, kinds)

    return archives.select(F.col("archive").cast("string"), "content").mapInArrow(run, "id long, url string, ip string, date string, kind string, block binary, payload_bytes long, digest string, archive string, error string")


def to_warc(spark: SparkSession, records: DataFrame, min_revisit: int = MIN_REVISIT, scratch: Scratch | None = None, file_bytes: int = 0) -> DataFrame:
    """The WARC record (binary column record) of every ARC record, revisits decided over all of them; with file_bytes, rows of so many bytes at most that hold whole records, END between them."""
    scratch = scratch or Scratch(spark, "warc")
    named = F.struct("id", "url", "date")
    repeated = records.where(F.col("id").isNotNull() & (F.col("payload_bytes") >= min_revisit)).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = scratch.table(repeated.select(F.col("digest").alias("__d"), F.col("first.id").alias("first"), F.concat_ws(" ", "first.url", "first.date").alias("name")), "repeated")
    joined = records.join(hint_if_small(repeated), F.col("digest") == F.col("__d"), "left")
    joined = joined.withColumn("refers", F.when((F.col("payload_bytes") >= min_revisit) & ~F.col("first").eqNullSafe(F.col("id")), F.col("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, held, size = [("record", pa.binary())], [], 0
        for whole in batches:
            for b in small_batches([whole], 4):
                c = dict(zip(b.schema.names, (x.to_pylist() for x in b.columns), strict=True))
                made = [warc_record(*x) for x in zip(c["url"], c["ip"], c["date"], c["kind"], c["block"], c["id"], c["refers"], c["name"], strict=True)]
                if not file_bytes:
                    yield _batch([(r,) for r in made], kind)
                    continue
                for r in made:
                    if held and size + len(r) > file_bytes:
                        yield _batch([(END.encode().join(held),)], kind)
                        held, size = [], 0
                    held.append(r)
                    size += len(r) + len(END)
        if held:
            yield _batch([(END.encode().join(held),)], kind)

    return joined.select("url", "ip", "date", "kind", "block", "id", "refers", "name").mapInArrow(run, "record binary")


def write_warc(records: DataFrame, path: str) -> None:
    """An archive per row of binary records. Spark's text writer adds the two line ends of the format after each."""
    records.select(F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, date, record_id. Digests of stored payloads are made anew and held against the header."""
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in parse_warc(content.as_py()):
                    h = r.headers
                    head, payload = http_parts(r.block)
                    key, digest = http_header(head, "X-Page-Id"), h["WARC-Payload-Digest"].removeprefix("sha256:")
                    revisit = h["WARC-Type"] == "revisit"
                    n = int(http_header(head, "Content-Length") or 0) if revisit else len(payload)
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} differs from its digest")
                    rows.append((int(key) if key else None, n, digest, h["WARC-Type"], key_of(h["WARC-Refers-To"]) if revisit else None, h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Record-ID"]))
                    if len(rows) == 5000:
                        yield _batch(rows, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string")


def convert_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages through ARC files to stored WARC archives, and what the archives hold."""
    scratch = Scratch(spark, "warc")
    records = arc_records(legacy_archives(pages)).where("error IS NULL").drop("archive", "error")
    path = scratch.path("archives")
    write_warc(to_warc(spark, records, scratch=scratch, file_bytes=FILE_BYTES), path)
    return read_warc(spark, path)
