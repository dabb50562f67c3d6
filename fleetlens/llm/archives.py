"""Web archives: pages are written as legacy ARC files, converted to WARC files and read back.

An ARC file begins with a version block that names its version and the fields of its header lines; each record is
a header line with a declared length, that many bytes, and a line end. Version 1 lines have five fields, version 2
lines ten. The converter parses the lines of either version, checks the declared lengths, and makes WARC 1.1
records of equivalent meaning: identifiers (a UUID of archive, offset and payload, so reruns agree), timestamps,
types (``warcinfo``, ``response``, ``resource``, ``revisit``) and SHA-1 digests of block and payload.

Of records with equal payloads of at least ``LEAST_BYTES`` bytes the one with the largest page_id stays a response,
and the others become revisits of it: they keep their HTTP head only. Which they are is decided on narrow rows
(digest, length, place); payloads are never grouped or joined. Equal payloads may be any share of all records.

Files are written by Spark as gzipped text whose line separator is what ends a record, one folder
``archive=<name>`` for each archive, cut at ``ARCHIVE_BYTES``. Whole archives are read as binary files, so they are
found in any store Spark reads.

Defined results: a null page is an empty one; a null or empty url is ``unknown:`` in the archives and null when read; blanks
and control characters in a url are percent-encoded; among equal payloads with equal page_ids the first record in
the archives is the response, a null page_id is the smallest; equal rows are records of their own; other
columns are not read. Damaged stretches of an ARC file (no header line, or a declared length that doesn't end at
a line end) are read as rows with a ``problem`` and not converted; reading goes on at the next header line. An
empty table gives no archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from decimal import Decimal

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import looked_up, written
from fleetlens.session import fresh_folder, remove_folder

#: Bytes of an archive before compression; one record may exceed it.
ARCHIVE_BYTES = 32 << 20
LEAST_BYTES = 1000
#: Pages carry no time of their own.
CAPTURED = "20000101000000"
BATCH_BYTES = 8 << 20
UNKNOWN = b"unknown:"

# Fixed values of the formats.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
HEADER_LINE = {
    1: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{12}|\d{14}) (?P<type>\S.*) (?P<length>\d+)"),
    2: re.compile(
        rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{14}) (?P<type>\S.*) (?P<code>\d{3}|-) (?P<checksum>\S+) "
        rb"(?P<location>\S+) (?P<offset>\d+) (?P<filename>\S+) (?P<length>\d+)"
    ),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_END, WARC_END = "\n", "\r\n\r\n"

_VERSION_BLOCK = re.compile(rb"filedesc://\S+ .* (\d+)")
_NO_HEAD = re.compile(rb"[\x00-\x20\x7f]")
_PAGE = re.compile(rb"(?im)^X-Page-Id: *(-?\d+) *\r?$")
_HTTP_LENGTH = re.compile(rb"(?im)^Content-Length: *(\d+) *\r?$")

ARC_SCHEMA = (
    "archive string, offset long, version int, url string, ip string, date string, content_type string, "
    "page_id long, payload_bytes long, payload_sha1 string, block binary, problem string"
)
WARC_SCHEMA = (
    "archive string, offset long, record_id string, record_type string, date string, url string, refers_to string, "
    "page_id long, payload_bytes long, payload_sha1 string, block binary, problem string"
)


# --- one record, one archive ------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    """What stands at one place of an ARC file; ``problem`` is set if it can't be read."""

    offset: int
    version: int | None = None
    url: bytes = b""
    ip: bytes = b""
    date: bytes = b""
    content_type: bytes = b""
    block: bytes = b""
    problem: str | None = None

    @property
    def payload(self) -> bytes:
        return self.block[len(http_head(self.block)) :]


def http_head(block: bytes) -> bytes:
    """The HTTP status line and header with the empty line behind it; empty if there is none."""
    if not block.startswith(b"HTTP/"):
        return b""
    ends = [at + len(end) for end in (b"\r\n\r\n", b"\n\n") if (at := block.find(end)) >= 0]
    return block[: min(ends)] if ends else block


def unzipped(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, its version block first, with what can't be read between them."""
    at, version, bad = 0, None, None

    def stretch(end: int) -> Iterator[ArcRecord]:
        if bad is not None:
            yield ArcRecord(bad, version, block=data[bad:end], problem="no record")

    while at < len(data):
        if data[at : at + 1] == b"\n" and bad is None:
            at += 1
            continue
        line_end = data.find(b"\n", at)
        line = data[at : line_end if line_end >= 0 else len(data)]
        begin = line_end + 1
        found, end = None, 0
        if line_end >= 0:
            if m := _VERSION_BLOCK.fullmatch(line):  # says how the lines from here on are to be read
                number = data[begin : begin + 2]
                version = int(number[:1]) if number in (b"1 ", b"2 ") else None
            if version and (found := HEADER_LINE[version].fullmatch(line)):
                end = begin + int(found["length"])
                if end > len(data) or (end < len(data) and data[end : end + 1] != b"\n"):
                    found = None
        if found is None:
            bad = at if bad is None else bad
            at = begin if line_end >= 0 else len(data)
            continue
        yield from stretch(at)
        bad = None
        yield ArcRecord(at, version, found["url"], found["ip"], found["date"], found["type"], data[begin:end])
        at = end + 1
    yield from stretch(len(data))


def version_block(name: str, version: int, date: str = CAPTURED) -> bytes:
    body = f"{version} 0 fleetlens\n{FIELDS[version]}\n".encode()
    more = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body


def arc_record(version: int, page_id: int | None, url: str | None, html: bytes, name: str, offset: int, date: str = CAPTURED) -> bytes:
    """A page as an ARC record, behind an HTTP head that carries its number."""
    page = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{page}\r\n".encode() + html
    address = _NO_HEAD.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode()) or UNKNOWN
    more = b"" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}".encode()
    return address + f" 0.0.0.0 {date} text/html".encode() + more + f" {len(block)}\n".encode() + block


def iso_time(date: bytes, fallback: str = "1970-01-01T00:00:00Z") -> str:
    """The 14 digits of an ARC date (12 in some files of version 1) as a WARC date."""
    try:
        return datetime.strptime(date.decode().ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return fallback


def record_id(archive: str, offset: int, payload_sha1: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{offset}/{payload_sha1}').urn}>"


def base32(sha1: str) -> str:
    return f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"


@dataclass
class Original:
    """The response that a revisit stands for."""

    archive: str
    offset: int
    url: str
    date: str


def warc_record(archive: str, record: ArcRecord, original: Original | None = None) -> bytes:
    """The WARC record, up to its end, that an ARC record stands for."""
    payload = record.payload
    digest = hashlib.sha1(payload).hexdigest()
    head = http_head(record.block)
    block, fields = record.block, []
    if record.url.startswith(b"filedesc:"):
        kind, content_type = "warcinfo", "application/warc-fields"
        fields.append(f"WARC-Filename: {archive}.warc")
        block = f"software: fleetlens\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC version {record.version}\r\n".encode()
    elif not head:
        kind, content_type = "resource", record.content_type.decode(errors="replace")
    else:
        kind, content_type = "response", "application/http; msgtype=response"
    if original:
        kind, block = "revisit", head
        fields += [
            f"WARC-Profile: {REVISIT_PROFILE}",
            f"WARC-Refers-To: {record_id(original.archive, original.offset, digest)}",
            f"WARC-Refers-To-Target-URI: {original.url}",
            f"WARC-Refers-To-Date: {iso_time(original.date.encode())}",
        ]
    if kind != "warcinfo":
        fields += [f"WARC-Target-URI: {record.url.decode(errors='replace')}", f"WARC-IP-Address: {record.ip.decode()}", f"WARC-Payload-Digest: {base32(digest)}"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(archive, record.offset, digest)}",
        f"WARC-Date: {iso_time(record.date)}",
        *fields,
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).hexdigest())}",
        f"Content-Type: {content_type}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def warc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Offset, header fields (names in small letters), block and problem of every record of a WARC file."""
    at = 0
    while at < len(data):
        head_end = data.find(b"\r\n\r\n", at)
        lines = data[at : max(head_end, at)].decode(errors="replace").split("\r\n")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        length = fields.get("content-length", "")
        if head_end < 0 or not lines[0].startswith("WARC/1.") or not length.isdecimal() or head_end + 4 + int(length) > len(data):
            yield at, fields, data[at:], "no record"
            return
        end = head_end + 4 + int(length)
        block = data[head_end + 4 : end]
        declared = fields.get("warc-block-digest")
        good = data[end : end + 4] == b"\r\n\r\n" and declared in (None, base32(hashlib.sha1(block).hexdigest()))
        yield at, fields, block, None if good else "other block than declared"
        at = end + 4


# --- files --------------------------------------------------------------------------------------------------------


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of BATCH_BYTES; column ``weight`` tells their size."""
    waiting, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        waiting.append(row)
        size += 200 + len(row[weight] or b"")
        if size >= BATCH_BYTES:
            yield out()
            waiting, size = [], 0
    if waiting:
        yield out()


_RECORDS = pa.schema([("archive", pa.string()), ("seq", pa.int64()), ("record", pa.binary())])


def _write(records: DataFrame, path: str, end: str) -> None:
    """Records (archive, seq, record) in their order, one folder per archive."""
    # an archive is never null: Spark then takes the order as it is
    ordered = records.withColumn("archive", F.coalesce("archive", F.lit(""))).sortWithinPartitions("archive", "seq")
    ordered.select("archive", F.col("record").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", end).option(
        "compression", "gzip"
    ).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """Name (of the folder ``archive=<name>``, else of the file) and content of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder, file = F.regexp_extract("path", "/archive=([^/]+)/[^/]+$", 1), F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(F.when(folder != "", folder).otherwise(file).alias("archive"), "content")


def write_arc(pages: DataFrame, path: str, version: int | None = None, archive_bytes: int | None = None) -> None:
    """Pages (page_id, url, html) as ARC files; without a version, archives of both versions take turns."""
    limit = archive_bytes or ARCHIVE_BYTES

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, nth, seq, offset = TaskContext.get().partitionId(), -1, 0, limit
        for batch in batches:
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                if offset >= limit:
                    nth, seq = nth + 1, 0
                    name, of_version = f"arc-{task:06d}-{nth:05d}", version or 1 + (task + nth) % 2
                    first = version_block(name, of_version)
                    offset = len(first) + 1
                    yield name, seq, first
                record = arc_record(of_version, page_id, url, html.as_py() or b"", name, offset)
                offset += len(record) + 1
                seq += 1
                yield name, seq, record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(records(batches), _RECORDS, 2)

    columns = [F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html")]
    _write(pages.select(*columns).mapInArrow(run, "archive string, seq long, record binary"), path, ARC_END)


def _text(value: bytes) -> str | None:
    return None if value == UNKNOWN else value.decode(errors="replace")


def _page_of(head: bytes) -> int | None:
    return int(m[1]) if (m := _PAGE.search(head)) else None


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of the ARC files below a path but the version blocks; see ``ARC_SCHEMA``. Without blocks rows are narrow."""
    schema = pa.schema(
        [(n, pa.string()) if k == "string" else (n, pa.int64() if k == "long" else pa.int32() if k == "int" else pa.binary()) for n, k in (f.split() for f in ARC_SCHEMA.split(", "))]
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                for r in arc_records(unzipped(content.as_py())):
                    if r.problem:
                        yield archive, r.offset, r.version, *[None] * 7, r.block if blocks else None, r.problem
                    elif not r.url.startswith(b"filedesc:"):
                        payload = r.payload
                        yield (
                            archive, r.offset, r.version, _text(r.url), r.ip.decode(), r.date.decode(), r.content_type.decode(errors="replace"),
                            _page_of(http_head(r.block)), len(payload), hashlib.sha1(payload).hexdigest(), r.block if blocks else None, None,
                        )

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema, 10), ARC_SCHEMA)


def revisits(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """archive, offset and the original's archive, offset, url and date of the records that revisit another one.

    ``records`` are rows of ``read_arc`` without blocks, written, so that their numbers stay.
    """
    keys = ["payload_sha1", "payload_bytes"]
    large = records.where(F.col("problem").isNull() & (F.col("payload_bytes") >= least_bytes))
    # one number for page and place, larger pages first, then earlier places: whole numbers aggregate by hash, structs don't
    rank = F.coalesce("page_id", F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(Decimal(10**19)) - F.col("place")
    large = large.withColumn("rank", rank).select("archive", "offset", "url", "date", *keys, "rank")
    first = large.groupBy(*keys).agg(F.max("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    original = large.select(F.col("rank").alias("first"), *[F.col(c).alias(f"to_{c}") for c in ("archive", "offset", "url", "date")])
    return looked_up(large, first.join(original, "first"), keys).where(F.col("rank") != F.col("first")).drop("rank", "first", "url", "date", *keys)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES) -> None:
    """WARC files from the ARC files below a path, an archive each."""
    place = F.monotonically_increasing_id()
    index = written(read_arc(spark, arc_path, blocks=False).withColumn("place", place), "arc-index")
    found = revisits(index, least_bytes).groupBy("archive").agg(F.collect_list(F.struct("offset", "to_archive", "to_offset", "to_url", "to_date")).alias("found"))
    both = _archives(spark, arc_path).join(found, "archive", "left")  # as many entries as an archive has records

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for archive, content, listed in zip(*(batch.column(c) for c in ("archive", "content", "found")), strict=True):
                archive = archive.as_py()
                originals = {e["offset"]: Original(e["to_archive"], e["to_offset"], e["to_url"] or UNKNOWN.decode(), e["to_date"]) for e in listed.as_py() or ()}
                for seq, r in enumerate(arc_records(unzipped(content.as_py()))):
                    if not r.problem:
                        yield archive, seq, warc_record(archive, r, originals.get(r.offset))

    _write(both.mapInArrow(lambda batches: _batches(records(batches), _RECORDS, 2), "archive string, seq long, record binary"), warc_path, WARC_END)


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of the WARC files below a path; see ``WARC_SCHEMA``. Bytes and digest are those of the full payload."""
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64() if k == "long" else pa.binary()) for n, k in (f.split() for f in WARC_SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for archive, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
                for offset, fields, block, problem in warc_records(unzipped(content.as_py())):
                    kind, head = fields.get("warc-type"), http_head(block)
                    payload, length, digest = block[len(head) :], None, None
                    if kind in ("response", "resource"):
                        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if problem is None and fields.get("warc-payload-digest") not in (None, base32(digest)):
                            problem = "other payload than declared"
                    elif kind == "revisit":
                        length = int(m[1]) if (m := _HTTP_LENGTH.search(head)) else None
                        declared = fields.get("warc-payload-digest", "")
                        digest = base64.b32decode(declared[5:]).hex() if declared.startswith("sha1:") else None
                    url = fields.get("warc-target-uri")
                    yield (
                        archive, offset, fields.get("warc-record-id"), kind, fields.get("warc-date"), None if url == UNKNOWN.decode() else url,
                        fields.get("warc-refers-to"), _page_of(head), length, digest, block if blocks else None, problem,
                    )

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), schema, 10), WARC_SCHEMA)


def archived(pages: DataFrame) -> DataFrame:
    """Pages through ARC and WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    arc, warc = fresh_folder(spark, "arc"), fresh_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    remove_folder(spark, arc)
    found = written(read_warc(spark, warc, blocks=False).where("record_type in ('response', 'revisit')"), "warc-index")
    remove_folder(spark, warc)
    columns = ["page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type"]
    responses = found.where("record_type = 'response'")
    originals = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("original"))
    again = found.where("record_type = 'revisit'").select(*columns, "refers_to")
    again = looked_up(again, originals, ["refers_to"]).drop("refers_to").withColumnRenamed("original", "refers_to")
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(again)


ORACLE = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), ranked AS (
  SELECT *, row_number() OVER same AS nth, first_value(page_id) OVER same AS original
  FROM payloads WINDOW same AS (PARTITION BY payload ORDER BY page_id DESC NULLS LAST)
)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_BYTES} AND nth > 1 THEN original END AS refers_to
FROM ranked
"""
