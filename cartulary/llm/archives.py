"""Legacy archive converter: ARC records become equivalent WARC records.

ARC, version 1: a line `URL IP date type length`; version 2: `URL IP date type status checksum location offset file length`. The
first record of an archive (filedesc://) has a version line, which tells how the other header lines are read. Declared lengths
count bytes; fields are split from the right, since old URLs may contain blanks. A record that ends early raises ValueError.

A converted record gets an identifier derived from its URL, date and content (equal in every run), an ISO timestamp from the
14-digit date, a type (response for HTTP content, else resource; revisit where another record has the same payload) and SHA-1
digests in base 32. Of records with equal payloads of at least min_revisit_bytes, that with the smallest page_id is the response.

Archives are standard .warc.gz files of FILE_RECORDS records, each a gzip member of its own, the first a warcinfo record. They are
written by Spark's text writer, with an empty gzip member as the line separator, in any file system that Spark writes, and get
their names after that; a record that has the separator's bytes in its compressed data is cut into two members there.

ARC and WARC files, our own or others', are read whole, a file a task (they are made of 100 MB by custom; Spark's reader of binary
files takes up to 2 GB), plain or in any sequence of gzip members; records are found by their declared lengths. Contents are bytes
and need not be text; bytes of header fields that are not UTF-8 are percent-encoded, so different URLs stay different. A null html
is empty, a null page_id counts as the smallest (revisits that refer to it have a null refers_to); rows that repeat in all columns
are each a record of the same type; empty tables give archives without records of pages.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.shared import NO_ID, doc_key, new_path, row_key, scratch, table, written
from cartulary.llm.words import chunks

#: Fields of a header line after the URL, by version.
ARC_FIELDS = {1: ("ip", "date", "type", "length"), 2: ("ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")}
#: What ends a WARC record.
RECORD_END = b"\r\n\r\n"
#: An empty gzip member, told from others by its comment: stands between the members of records.
SEPARATOR = b"\x1f\x8b\x08\x10\x00\x00\x00\x00\x00\xff" + b"cartulary: end of record 5d0f9c1ab3e74286\x00" + b"\x03\x00" + bytes(8)
#: Records of an archive file, with its warcinfo record.
FILE_RECORDS = 10_000
#: Bytes of blocks in a batch of read records, about; bytes that a gzip reader is given at a time.
BATCH_BYTES, READ_BYTES = 1 << 22, 1 << 14
#: A record to be converted: key and row order and identify it (the smallest key is the response), page_id is what the result calls it.
RECORDS = "key long, row long, page_id long, url string, ip string, date string, type string, content binary"


codecs.register_error("percent", lambda e: ("".join(f"%{x:02X}" for x in e.object[e.start : e.end]), e.end))


@dataclass
class ArcRecord:
    url: str
    fields: dict[str, str]
    content: bytes


def digest(data: bytes) -> str:
    """Bare upper-case base-32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def build_arc(records: list[tuple[str, str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC archive of (url, 14-digit date, content)."""
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = f"{version} 0 converter\n{names}\n".encode()
    middle = "" if version == 1 else f"200 - - 0 {name} "
    out = [f"filedesc://{name} 0.0.0.0 {records[0][1] if records else '19960101000000'} text/plain {middle}{len(block)}\n".encode(), block, b"\n"]
    at = sum(map(len, out))
    for url, date, content in records:
        middle = "" if version == 1 else f"200 {digest(content)[:8]} - {at} {name} "
        out += [f"{url} 0.0.0.0 {date} text/html {middle}{len(content)}\n".encode(), content, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an archive, without its filedesc record."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header at {at} has no end")
        line = data[at:end].decode("utf-8", "percent").rstrip("\r")
        if version is None:
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[end + 1 : end + 1 + length].split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            url, *fields = line.rsplit(" ", len(ARC_FIELDS[version]))
            if len(fields) != len(ARC_FIELDS[version]):
                raise ValueError(f"ARC header at {at} isn't of version {version}")
            length = int(fields[-1])
            if end + 1 + length > len(data):
                raise ValueError(f"ARC record at {at} declares {length} bytes")
            yield ArcRecord(url, dict(zip(ARC_FIELDS[version], fields, strict=True)), data[end + 1 : end + 1 + length])
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; no head if the content isn't HTTP."""
    if content.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (k := content.find(mark)) >= 0:
                return content[: k + len(mark)], content[k + len(mark) :]
    return b"", content


def warc_date(date: str) -> str:
    """ISO time of an ARC date of 14 digits; shorter ones (early archives) are padded to the start of their period."""
    return datetime.strptime(date + "19960101000000"[len(date) :], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def to_warc(record: ArcRecord, key: str | None = None, revisit_of: str | None = None, extra: dict[str, str] | None = None) -> tuple[bytes, bytes]:
    """Head and block of the WARC record, whose identifier comes from key (else URL and date) and payload.

    revisit_of: key of the response with the same payload, which is then left out."""
    head, payload = split_http(record.content)
    own = digest(payload)
    kind = "revisit" if revisit_of is not None else "response" if head else "resource"
    block = head if revisit_of is not None else record.content
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(f"{record.url} {record.fields['date']}" if key is None else key, own), "WARC-Date": warc_date(record.fields["date"]), "WARC-Target-URI": record.url, "WARC-IP-Address": record.fields["ip"],
        "WARC-Payload-Digest": f"sha1:{own}", "WARC-Block-Digest": f"sha1:{digest(block)}", "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response" if head else record.fields["type"], "Content-Length": str(len(block)),
    } | ({"WARC-Refers-To": record_id(revisit_of, own), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"} if revisit_of is not None else {}) | (extra or {})
    return _head(fields), block


def _head(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def warcinfo(first: ArcRecord) -> bytes:
    """The record at the head of a file, whose first other record is given."""
    block = b"software: cartulary\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", first.url, first.fields["date"], digest(first.content)), "WARC-Date": warc_date(first.fields["date"]), "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}
    return _head(fields) + block + RECORD_END


def parse_warc(parts: bytes | Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and block of each record, by declared length; parts follow one another and may begin anywhere."""
    rest, at = b"", 0
    for part in [parts] if isinstance(parts, bytes) else parts:
        rest, at = rest[at:] + part, 0
        while (end := rest.find(b"\r\n\r\n", at)) >= 0:
            if not rest.startswith(b"WARC/", at):
                raise ValueError(f"no WARC record: {rest[at : at + 20]!r}")
            lines: list[str] = []
            for line in rest[at:end].decode("utf-8", "percent").split("\r\n")[1:]:
                if line[:1] in (" ", "\t") and lines:  # a folded field goes on
                    lines[-1] += f" {line.strip()}"
                else:
                    lines.append(line)
            fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = next((int(v) for k, v in fields.items() if k.lower() == "content-length"), None)
            if length is None:
                raise ValueError(f"WARC record without a length: {lines[:2]}")
            stop = end + 4 + length
            if len(rest) < stop + len(RECORD_END):
                break
            if not rest.startswith(RECORD_END, stop):
                raise ValueError(f"WARC record doesn't end after {length} bytes: {lines[:2]}")
            yield fields, rest[end + 4 : stop]
            at = stop + len(RECORD_END)
    if rest[at:].strip():
        raise ValueError(f"WARC record is cut off: {rest[at : at + 20]!r}")


def _capture(page: int | None, url: str | None, html: bytes) -> tuple[str, str, bytes]:
    """A page as an old crawler kept it."""
    date = (datetime(1996, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=(page or 0) % 10**9)).strftime("%Y%m%d%H%M%S")
    return (url or "").replace("\n", "%0A").replace("\r", "%0D"), date, b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page: %s\r\n\r\n" % str("" if page is None else page).encode() + html


def member(data: bytes) -> bytes:
    """data as gzip members (one, unless it has SEPARATOR inside), in which SEPARATOR doesn't occur."""
    out = zlib.compress(data, 1, 31)
    if SEPARATOR not in out:
        return out
    at = data.index(SEPARATOR) + len(SEPARATOR) // 2
    return member(data[:at]) + member(data[at:])


def member_contents(data: bytes) -> Iterator[bytes]:
    """The contents of each gzip member; data itself if it isn't gzip. Bytes of zero between members are passed over."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"\0":
            at += 1
            continue
        reader, out = zlib.decompressobj(31), []
        while not reader.eof and at < len(data):
            piece = data[at : at + READ_BYTES]
            out.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        if not reader.eof:
            raise ValueError("gzip member is cut off")
        yield b"".join(out)


def members(data: bytes) -> bytes:
    """The contents of all gzip members, one after the other."""
    return b"".join(member_contents(data))


def _of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages, written to an ARC archive and parsed again; versions take turns."""
    for batch in batches:
        for b in chunks(batch, "html"):
            pages, urls = b.column("page_id").to_pylist(), b.column("url").to_pylist()
            html = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("html")]
            version = 1 + (pages[0] or 0) % 2 if pages else 1
            found = list(parse_arc(build_arc([_capture(*x) for x in zip(pages, urls, html, strict=True)], version)))
            yield _records(found, b.column("key"), b.column("row"), b.column("page_id"))


def _records(found: list[ArcRecord], key: pa.Array, row: pa.Array, page: pa.Array) -> pa.RecordBatch:
    text = lambda values: pa.array(list(values), pa.string())
    fields = (text(r.fields[k] for r in found) for k in ("ip", "date", "type"))
    return pa.record_batch([key, row, page, text(r.url for r in found), *fields, pa.array([r.content for r in found], pa.binary())], names=["key", "row", "page_id", "url", "ip", "date", "type", "content"])


def legacy_records(pages: DataFrame) -> DataFrame:
    """RECORDS of pages (page_id, url, html), by way of ARC archives."""
    rows = pages.select(doc_key("page_id").alias("key"), row_key("url", "html").alias("row"), "page_id", "url", "html")
    return rows.mapInArrow(_of_pages, RECORDS)


def _of_arc_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column("key").to_pylist(), b.column("content"), strict=True):
            found: list[ArcRecord] = []
            size = at = 0
            for record in parse_arc(members(content.as_buffer().to_pybytes())):
                found.append(record)
                size += len(record.content)
                if size > 1 << 22:
                    yield _numbered(found, name, at)
                    at, found, size = at + len(found), [], 0
            yield _numbered(found, name, at)


def _numbered(found: list[ArcRecord], name: int, at: int) -> pa.RecordBatch:
    n = len(found)
    return _records(found, pa.array([name] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.int64()))


def read_arc(spark, path: str) -> DataFrame:
    """RECORDS of ARC files: key is a hash of the file's path, row the record's number in it."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(row_key("path").alias("key"), "content").mapInArrow(_of_arc_files, RECORDS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        payloads = [split_http(x.as_buffer().to_pybytes())[1] for x in b.column("content")]
        yield pa.record_batch([b.column("key"), b.column("row"), pa.array([digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], names=["key", "row", "digest", "size"])


def _to_members(file_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0  # records so far; the writer begins a file after each file_records
        for batch in batches:
            for b in chunks(batch, "content"):
                out = []
                for r in b.to_pylist():
                    record = ArcRecord(r["url"], {k: r[k] for k in ("ip", "date", "type")}, r["content"])
                    extra = {"X-Page": "" if r["page_id"] is None else str(r["page_id"])}
                    first = r["first"]
                    if first is not None:
                        extra["X-Refers-To-Page"] = "" if first["page_id"] is None else str(first["page_id"])
                    head, block = to_warc(record, f"{r['key']} {r['row']}", None if first is None else f"{first['key']} {first['row']}", extra)
                    new = ([] if n % file_records else [member(warcinfo(record))]) + [member(head + block + RECORD_END)]
                    out += new
                    n += len(new)
                yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[dict[str, str], bytes]]]:
    """The records of files (content), some BATCH_BYTES at a time."""
    for batch in batches:
        for value in batch.column("content"):
            found, size = [], 0
            for record in parse_warc(member_contents(value.as_buffer().to_pybytes())):
                found.append(record)
                size += len(record[1])
                if size >= BATCH_BYTES:
                    yield found
                    found, size = [], 0
            yield found


def _fields_and_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _read(batches):
        yield pa.record_batch([pa.array([list(f.items()) for f, _ in found], pa.map_(pa.string(), pa.string())), pa.array([x for _, x in found], pa.binary())], names=["fields", "block"])


def _of_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in _read(batches):
        out: list[list] = [[], [], [], [], []]
        for fields, block in found:
            if (kind := fields["WARC-Type"]) == "warcinfo":
                continue
            own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind != "revisit":
                payload = split_http(block)[1]
                if digest(payload) != own or len(payload) != int(fields["X-Payload-Length"]):
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
            number = lambda k: int(fields[k]) if fields.get(k) else None  # noqa: B023, E731
            for column, x in zip(out, (number("X-Page"), number("X-Payload-Length"), own, kind, number("X-Refers-To-Page")), strict=True):
                column.append(x)
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _name_files(spark, path: str) -> None:
    """Gives the files that Spark's text writer made the names of archives."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for x in system.listStatus(place):
        old = x.getPath()
        if (name := old.getName()).startswith("part-"):
            system.rename(old, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place, f"{name.removesuffix('.txt')}.warc.gz"))


def convert(records: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """Writes RECORDS as WARC archives to path. They are made twice, for the digests and for the archives, instead of being stored."""
    with scratch():
        found = written(records.select("key", "row", "content").mapInArrow(_digests, "key long, row long, digest string, size long"), "digests")
        first = found.filter(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min(F.struct("key", "row")).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        first = written(first, "first").hint("merge")  # a table of its own: Spark can split the join at a frequent payload
        revisits = found.join(first, "digest").filter("key <> f.key or row <> f.row").select("key", "row", "f").distinct()
        revisits = written(revisits, "revisits").hint("merge")
        page = F.struct("f.key", "f.row", F.when(F.col("f.key") != NO_ID, F.col("f.key")).alias("page_id"))
        rows = records.join(revisits, ["key", "row"], "left").select("key", "row", "page_id", "url", "ip", "date", "type", "content", F.when(F.col("f").isNotNull(), page).alias("first"))
        # The JVM takes the bytes as they are.
        lines = rows.mapInArrow(_to_members(FILE_RECORDS), "value binary").select(F.col("value").cast("string").alias("value"))
        lines.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)
        _name_files(records.sparkSession, path)


def _warc_files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")


def read_warc(spark, path: str) -> DataFrame:
    """fields and block of each record of the WARC files (*.warc, *.warc.gz) at a path."""
    return _warc_files(spark, path).mapInArrow(_fields_and_blocks, "fields map<string,string>, block binary")


def read_archives(spark, path: str) -> DataFrame:
    """A row per record of a page that convert() wrote: page_id, payload_bytes, payload_digest, record_type, refers_to. Payloads are held against their digests."""
    return _warc_files(spark, path).mapInArrow(_of_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_archives(spark, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = new_path(spark, "warc")
    convert(legacy_records(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path)


OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
x AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p),
c AS (SELECT *, [CAST(('0x' || substr(h, 1 + 5 * CAST(k AS INTEGER), 5)) AS BIGINT) FOR k IN range(8)] AS v FROM x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[1 + CAST(j // 4 AS INTEGER)] >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1) FOR j IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM c
"""
