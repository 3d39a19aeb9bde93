"""Legacy archives: ARC files (versions 1 and 2) and their conversion to WARC.

An ARC file begins with a version block that names the fields of its header lines; each record is such a line and the declared number of
bytes. The converter reads records by those lengths alone and synthesises what WARC wants: record ids, timestamps, types and digests.
Every record is a gzip member of its own, so that it can be read by its offset. Files are written by Spark's text writer, with an empty member as line separator, and read
through `binaryFile`, so any store that Spark reaches will do and lost tasks leave nothing behind. A file is as large as the part of the table that its task read, and must fit
into a worker's memory.

Payloads are never shuffled: what decides between response and revisit are digests and places, and the archives meet the decisions file by file, compressed.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import scratch_path, written

#: The header fields that the two versions declare.
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
_CAPTURED = datetime(2000, 1, 1, tzinfo=UTC)
_BATCH = 4 << 20
#: zlib's level, between its fastest and its usual one.
LEVEL = 4
RECORD = "file string, at bigint, archive string, version int, page_id bigint, url string, ip string, date string, http binary, payload binary, payload_bytes bigint, payload_digest string"


def member(data: bytes) -> bytes:
    """One gzip member."""
    codec = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return codec.compress(data) + codec.flush()


def _write_members(rows: DataFrame, path: str) -> None:
    """Rows of one binary column, each a gzip member, as files: the separator that a text file has after each row is an empty member."""
    lines = rows.select(F.col("value").cast("string").alias("value"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


class _Inflated(io.RawIOBase):
    """A file's bytes, gunzipped piece by piece if they are gzip (members one after another are one stream)."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.left = memoryview(data), 0, b""
        self.gzip = data[:2] == b"\x1f\x8b"
        self.codec = zlib.decompressobj(31) if self.gzip else None

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.left and self.at < len(self.data):
            piece = bytes(self.data[self.at : self.at + 65536])
            self.at += len(piece)
            while piece and self.gzip:
                self.left += self.codec.decompress(piece)
                piece = self.codec.unused_data
                if self.codec.eof:
                    self.codec = zlib.decompressobj(31)
                else:
                    break
            if not self.gzip:
                self.left = piece
        n = min(len(out), len(self.left))
        out[:n], self.left = self.left[:n], self.left[n:]
        return n


def _exactly(stream: io.BufferedReader, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise ValueError(f"the archive ends within a record: {len(data)} of {n} bytes")
    return data


def arc_header(version: int, url: str, ip: str, date: str, kind: str, length: int, status: str = "200", checksum: str = "-", offset: int = 0, file: str = "-") -> str:
    """A header line of the version; white space in the url is percent-encoded."""
    url = re.sub(r"[\s\x00-\x1f\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "unknown:"
    fields = [url, ip, date, kind] + ([status, checksum, "-", str(offset), file] if version == 2 else [])
    return " ".join([*fields, str(length)])


def read_arc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Records of an ARC file as (version, number, header fields, declared bytes); the version block is number 0."""
    stream, names, version, number = io.BufferedReader(_Inflated(data)), [], 1, 0
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if not names:
            parts = line.split(b" ")
            block = _exactly(stream, int(parts[-1]))
            first, second = block.decode("latin-1").split("\n")[:2]
            version, names = int(first.split(" ")[0]), second.strip().split(" ")
            yield version, number, {"URL": parts[0].decode("latin-1")}, block
        else:
            # Old urls hold spaces: the other fields are counted from the right.
            parts = line.rsplit(b" ", len(names) - 1)
            if len(parts) != len(names):
                raise ValueError(f"not a header line of version {version}: {line[:200]!r}")
            head = dict(zip(names, (p.decode("utf-8", "replace") for p in parts)))
            yield version, number, head, _exactly(stream, int(head["Archive-length"]))
        number += 1


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file as (headers, block)."""
    stream = io.BufferedReader(_Inflated(data))
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:200]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            head[name.strip()] = value.strip()
        yield head, _exactly(stream, int(head["Content-Length"]))


def _http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("latin-1").strip() if found else None


def _pages_to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    version, first = 1 + part % 2, True
    for batch in batches:
        rows, size = [], 0
        if first and batch.num_rows:
            block = f"{version} 0 pairlens\n{FIELDS[version]}\n"
            rows.append(member((arc_header(version, f"filedesc://part-{part}.arc", "0.0.0.0", "20000101000000", "text/plain", len(block)) + "\n" + block + "\n").encode()))
            first = False
        for page, url, html in zip(*(batch.column(k) for k in range(3))):
            page, body = page.as_py(), (html.as_py() or "").encode()
            length = len(body)
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
            date = (_CAPTURED + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
            rows.append(member((arc_header(version, url.as_py() or "", "0.0.0.0", date, "text/html", len(http) + length) + "\n" + http).encode() + body + b"\n"))
            size += length
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write a record per row, one ARC file per task, in version 1 and 2 by turns. A null body is empty, a null url `unknown:`."""
    rows = pages.select(F.col(id_col).cast("bigint"), F.col(url_col).cast("string"), F.col(body_col).cast("string"))
    _write_members(rows.mapInArrow(_pages_to_arc, "value binary"), path)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += 200 + weight(row)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), schema)], schema=schema)
            group, size = [], 0
    if group:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*group), schema)], schema=schema)


_RECORD_ARROW = pa.schema([("file", pa.string()), ("at", pa.int64()), ("archive", pa.string()), ("version", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("http", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _records_of(data: bytes) -> Iterator[tuple]:
    """The fields of RECORD but the file, of every record of an ARC file; the version block first, as number 0 without payload fields."""
    name = ""
    for version, number, head, block in read_arc(data):
        if not number:
            name = head["URL"].removeprefix("filedesc://")
            yield number, name, version, None, head["URL"], None, None, block, b"", 0, ""
            continue
        http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        page = _http_field(http, b"X-Page-Id")
        yield number, name, version, int(page) if page else None, head["URL"], head["IP-address"], head["Archive-date"], http + gap, payload, len(payload), hashlib.sha256(payload).hexdigest()


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for number, name, version, page, url, ip, date, http, payload, size, digest in _records_of(content.as_py()):
                    if number:
                        yield path.as_py(), number, name, version, page, url, ip, date, http, payload, size, digest

    return _batches(rows(), _RECORD_ARROW, lambda r: r[10])


_PLACE = pa.schema([("file", pa.string()), ("at", pa.int64()), ("archive", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _arc_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What decides about a record, without its bytes."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for number, name, _, page, _, _, _, _, _, size, digest in _records_of(content.as_py()):
                    if number:
                        yield path.as_py(), number, name, page, size, digest

    return _batches(rows(), _PLACE, lambda r: 0)


def _arc_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files in a folder."""
    return _arc_files(spark, path).mapInArrow(_arc_records, RECORD)


def _record_id(archive: str, at: int) -> str:
    """From the archive's own name and the record's number in it: the same wherever and whenever it is converted."""
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{at}').urn}>"


def _info_record(name: str, version: int, block: bytes) -> bytes:
    """The version block as a warcinfo record."""
    fields = f"software: pairlens\r\nformat: WARC File Format 1.1\r\nsource-format: ARC version {version}\r\nsource-block: {block.decode('latin-1').strip()!r}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {_record_id(name, 0)}", f"WARC-Date: {_CAPTURED:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return "\r\n".join([*head, f"Content-Length: {len(fields)}", "", ""]).encode() + fields


def _warc_record(archive: str, at: int, url: str, ip: str, date: str, http: bytes, payload: bytes, digest: str, first: tuple[str, int] | None) -> bytes:
    """Id from the record's place, date from the header line, type from the decision (`first`: the response's place), digests from the bytes."""
    stamp = date.ljust(14, "0")
    block = http + payload if first is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(archive, at)}",
        f"WARC-Warcinfo-ID: {_record_id(archive, 0)}",
        f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{digest if not http and first is None else hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if first is not None:
        head += [f"WARC-Refers-To: {_record_id(*first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for content, revisits in zip(batch.column(0), batch.column(1)):
                decided = {r["at"]: (r["archive"], r["first_at"]) for r in revisits.as_py() or []}
                for number, name, version, _, url, ip, date, http, payload, _, digest in _records_of(content.as_py()):
                    record = _warc_record(name, number, url, ip, date, http, payload, digest, decided.get(number)) if number else _info_record(name, version, http)
                    yield (member(record + b"\r\n\r\n"),)

    return _batches(rows(), pa.schema([("value", pa.binary())]), lambda r: len(r[0]))


def convert(spark: SparkSession, arcs: str, path: str) -> None:
    """Write the ARC files of a folder as WARC: of equal payloads of at least `LEAST_REVISIT` bytes the one with the smallest page id is the response.

    Among equal or null page ids (null ones come last) the place in the archives decides. Digests that occur once are never joined; decisions reach the archives
    as one row per file, whose size the file bounds.
    """
    places = written(_arc_files(spark, arcs).mapInArrow(_arc_places, "file string, at bigint, archive string, page_id bigint, payload_bytes bigint, payload_digest string"), "places")
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "archive", "at", "file")
    large = places.where(F.col("payload_bytes") >= LEAST_REVISIT)
    several = large.groupBy("payload_digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    later = large.join(several, "payload_digest").where("file <> first.file or at <> first.at")
    per_file = later.groupBy("file").agg(F.collect_list(F.struct("at", F.col("first.archive").alias("archive"), F.col("first.at").alias("first_at"))).alias("revisits"))
    files = _arc_files(spark, arcs)
    _write_members(files.join(per_file, F.col("path") == F.col("file"), "left").select("content", "revisits").mapInArrow(_to_warc, "value binary"), path)


_READ = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string())])


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(0):
                for head, block in read_warc(content.as_py()):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
                    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                    page, kind = _http_field(http, b"X-Page-Id"), head["WARC-Type"]
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and digest != hashlib.sha256(payload).hexdigest():
                        raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
                    size = len(payload) if kind == "response" else int(_http_field(http, b"Content-Length") or 0)
                    yield int(page) if page else None, head["WARC-Record-ID"], head.get("WARC-Refers-To"), kind, size, digest, head["WARC-Target-URI"], head["WARC-Date"]

    return _batches(rows(), _READ, lambda r: 0)


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row per response and revisit of all WARC files in a folder, with digests verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_warc_rows, "page_id bigint, record_id string, refers_to_id string, record_type string, payload_bytes bigint, payload_digest string, target_uri string, warc_date string")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write the pages as ARC, convert the archives to WARC, read those back.

    Returns `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` (page id of the response), `target_uri`, `warc_date`,
    a row per page (repeated and null ids, null urls and empty bodies included; an empty table gives an empty result).
    """
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arcs, id_col, url_col, body_col)
    convert(spark, arcs, warcs)
    rows = written(read_warcs(spark, warcs), "records")
    targets = rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return rows.join(targets, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date")
