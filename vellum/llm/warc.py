"""Legacy archive converter: ARC files to WARC, both written and read through Spark.

ARC records are found by their header line, whose fields the file's version block
names, and by the length it declares. Each becomes a WARC record: the 14-digit date
becomes an ISO timestamp, the kind follows from scheme and media type, and identifier
and SHA-1 digests are derived, as ARC has none. Of large equal payloads one record stays
a response; the others become revisits of it, without the payload.

Archives are gzip files of bounded size in a folder that all executors share. Spark's
own text sink writes them, one archive a row, and its binary source reads them, so no
worker opens a path. The sink holds UTF-8, so payloads must be UTF-8 text, and compresses
an archive as a whole; files of a member a record are read as well.

Defined cases: a null payload is empty; a null or unprintable URL is escaped; a record
without an id is never preferred as response; records that share the preferred id are
all responses; an empty table gives no rows; other columns are ignored.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, pinned, shared_path, slices

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Characters that one archive holds before the next begins; a record is never split.
ARCHIVE_CHARS = 16_000_000
ARC_DATE = "20240101000000"

# Field names of the two ARC versions and the two WARC profiles.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

RECORD = "record_id string, url string, ip string, date string, kind string, media string, http string, page_id bigint, size bigint, sha1 string, payload string"


def inflated(content: bytes) -> bytes:
    """The bytes of a gzip file of any number of members; other content as it is."""
    out, at, held = [], 0, memoryview(content)
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        # In pieces, so that what follows a member is not copied with each.
        while not member.eof and at < len(content):
            piece = held[at : at + 65_536]
            out.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        out.append(member.flush())
    return b"".join([*out, held[at:]])


def arc_url(url: str | None) -> str:
    return quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "about:blank"


def http_head(size: int, page_id: int | None) -> bytes:
    mark = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n{mark}\r\n".encode()


def arc_head(name: str, version: int, date: str) -> bytes:
    block = f"{version} 0 vellum\n{ARC_FIELDS[version]}\n".encode()
    more = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {more}{len(block)}\n".encode() + block + b"\n"


def arc_record(name: str, version: int, date: str, url: str | None, offset: int, block: bytes) -> bytes:
    more = f"200 {hashlib.md5(block).hexdigest()} - {offset} {name} " if version == 2 else ""
    return f"{arc_url(url)} 0.0.0.0 {date} text/html {more}{len(block)}\n".encode() + block + b"\n"


def parse_arc(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields by name, block) of every record, the version block first.

    The version block says which fields header lines have. Blank lines between records
    are skipped; a header line that doesn't fit or a block cut short is an error.
    """
    at, names = 0, None
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(content):
            return
        line_end = content.index(b"\n", at)
        fields = content[at:line_end].decode("utf-8").rstrip("\r").split(" ")
        size, begin = int(fields[-1]), line_end + 1
        block = content[begin : begin + size]
        if len(block) != size:
            raise ValueError(f"ARC record at {at} declares {size} bytes, {len(block)} are left")
        if names is None:
            names = block.decode("utf-8").splitlines()[1].split(" ")
            version_names = [n.lower() for n in names]
            yield at, dict(zip([*version_names[:-1][: len(fields) - 1], version_names[-1]], fields)), block
        else:
            if len(fields) != len(names):
                raise ValueError(f"ARC header at {at} has {len(fields)} fields, not {len(names)}")
            yield at, dict(zip(version_names, fields)), block
        at = begin + size


def _undamaged(records: Iterator, strict: bool) -> Iterator:
    """The records; a damaged one is an error, or else the end of its archive."""
    while True:
        try:
            record = next(records)
        except StopIteration:
            return
        except (ValueError, KeyError, IndexError):
            if strict:
                raise
            return
        yield record


def iso_date(digits: str) -> str:
    """14, 12 or 8 digits to an ISO timestamp."""
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_kind(url: str, block: bytes) -> str:
    if url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if block.startswith(b"HTTP/") else "resource"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with its blank line, and body; no head if the block has none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def _page_id(head: bytes) -> int | None:
    m = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(m[1]) if m else None


def _archives(batches: Iterator[pa.RecordBatch], head, record, tail: bytes, chars: int) -> Iterator[pa.RecordBatch]:
    """Archive texts of about ``chars`` from rows; ``record(name, no, offset, row)`` gives the bytes of one."""
    held: list[bytes] = []
    name, size, number, stem = "", 0, 0, uuid.uuid4().hex
    for batch in slices(batches, 256):
        for row in batch.to_pylist():
            if not held:
                name = f"{stem}-{number:05d}"
                held = [head(name, number)]
                size = len(held[0])
            held.append(record(name, number, size, row))
            size += len(held[-1])
            if size >= chars:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(held).removesuffix(tail).decode("utf-8")])], ["value"])
                held, number = [], number + 1
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held).removesuffix(tail).decode("utf-8")])], ["value"])


def _store(archives: DataFrame, path: str, end: str) -> None:
    archives.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chars: int = ARCHIVE_CHARS) -> None:
    """Store pages as ARC files, versions 1 and 2 in turn."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(name: str, number: int, offset: int, row: dict) -> bytes:
            body = (row["html"] or "").encode()
            return arc_record(name, number % 2 + 1, ARC_DATE, row["url"], offset, http_head(len(body), row["id"]) + body)

        return _archives(batches, lambda name, number: arc_head(name, number % 2 + 1, ARC_DATE), record, b"\n", chars)

    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    _store(rows.mapInArrow(build, "value string"), path, "\n")


def _archive_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def read_arc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records of ARC files as WARC fields (RECORD), the version blocks left out.

    A damaged record fails the job; unless ``strict``, it ends its archive.
    """
    import pyspark.sql.pandas.types as types
    from pyspark.sql.types import StructType

    schema = types.to_arrow_schema(StructType.fromDDL(RECORD))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, name = [], ""
                for offset, fields, block in _undamaged(parse_arc(inflated(content.as_py())), strict):
                    url = fields["url"]
                    if warc_kind(url, block) == "warcinfo":
                        name = url
                        continue
                    head, body = split_http(block)
                    rows.append(
                        {
                            "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}>",
                            "url": url,
                            "ip": fields["ip-address"],
                            "date": iso_date(fields["archive-date"]),
                            "kind": warc_kind(url, block),
                            "media": "application/http; msgtype=response" if head else fields["content-type"],
                            "http": head.decode("utf-8"),
                            "page_id": _page_id(head),
                            "size": len(body),
                            "sha1": hashlib.sha1(body).hexdigest(),
                            "payload": body.decode("utf-8"),
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _archive_files(spark, path).mapInArrow(convert, RECORD)


def with_revisits(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """RECORD columns and ``refers`` (id, url and date of the response that a revisit repeats, else null)."""
    large = F.col("size") >= least
    prefer = F.struct(F.col("page_id"), F.col("record_id"), F.col("url"), F.col("date"))
    groups = (
        records.filter(large)
        .groupBy(F.col("sha1").alias("_sha1"), F.col("size").alias("_size"))
        .agg(F.count("*").alias("_n"), F.max(prefer).alias("_best"))
        .filter("_n > 1")
        .drop("_n")
    )
    found = records.join(lookup(groups), large & (F.col("sha1") == F.col("_sha1")) & (F.col("size") == F.col("_size")), "left")
    again = F.col("_best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_best.page_id"))
    return found.withColumn("refers", F.when(again, F.col("_best"))).drop("_sha1", "_size", "_best")


def _base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def warc_record(row: dict) -> bytes:
    """One record with its headers, block and end; a revisit keeps only the HTTP head."""
    refers = row["refers"]
    block = row["http"].encode() + (b"" if refers else row["payload"].encode())
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if refers else row['kind']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha1:{_base32(row['sha1'])}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        f"X-Payload-Length: {row['size']}",
    ]
    if refers:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {refers['record_id']}",
            f"WARC-Refers-To-Target-URI: {refers['url']}",
            f"WARC-Refers-To-Date: {refers['date']}",
            "WARC-Truncated: length",
        ]
    lines += [f"Content-Type: {row['media']}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _warcinfo(name: str) -> bytes:
    block = b"software: vellum\r\nformat: WARC File Format 1.0\r\n"
    record = uuid.uuid5(uuid.NAMESPACE_URL, name)
    head = f"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{record}>\r\nWARC-Date: {iso_date(ARC_DATE)}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str, chars: int = ARCHIVE_CHARS) -> None:
    """Store records (RECORD and ``refers``) as WARC files."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _archives(batches, lambda name, _: _warcinfo(name), lambda name, no, at, row: warc_record(row), b"\r\n\r\n", chars)

    _store(records.mapInArrow(build, "value string"), path, "\r\n\r\n")


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record, by declared length."""
    at = 0
    while True:
        while content[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(content):
            return
        head_end = content.index(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        size, begin = int(headers["content-length"]), head_end + 4
        block = content[begin : begin + size]
        if len(block) != size:
            raise ValueError(f"WARC record at {at} declares {size} bytes, {len(block)} are left")
        yield headers, block
        at = begin + size


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """record_id, record_type, page_id, payload_bytes, payload_digest and refers_id of stored records.

    A response's length and digest come from its payload, and must agree with its headers.
    A damaged record fails the job; unless ``strict``, it ends its archive.
    """
    columns = "record_id string, record_type string, page_id bigint, payload_bytes bigint, payload_digest string, refers_id string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ids, kinds, pages, sizes, digests, refers = [], [], [], [], [], []
                for headers, block in _undamaged(parse_warc(inflated(content.as_py())), strict):
                    if headers["warc-type"] == "warcinfo":
                        continue
                    head, body = split_http(block)
                    told = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(headers["x-payload-length"])
                    if headers["warc-type"] != "revisit" and (hashlib.sha1(body).hexdigest() != told or len(body) != size):
                        raise ValueError(f"payload of {headers['warc-record-id']} does not match its headers")
                    ids.append(headers["warc-record-id"])
                    kinds.append(headers["warc-type"])
                    pages.append(_page_id(head))
                    sizes.append(size)
                    digests.append(told)
                    refers.append(headers.get("warc-refers-to"))
                arrays = [pa.array(ids, pa.string()), pa.array(kinds, pa.string()), pa.array(pages, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(refers, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["record_id", "record_type", "page_id", "payload_bytes", "payload_digest", "refers_id"])

    return _archive_files(spark, path).mapInArrow(scan, columns)


def convert_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES, chars: int = ARCHIVE_CHARS) -> DataFrame:
    """Pages through ARC and WARC archives and back: read_warc's columns and refers_to, the response's page id."""
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col, chars)
    write_warc(with_revisits(read_arc(spark, arc), least), warc, chars)
    stored = pinned(read_warc(spark, warc))
    wanted = stored.filter(F.col("refers_id").isNotNull()).select(F.col("refers_id").alias("record_id")).distinct()
    known = lookup(stored.join(wanted, "record_id", "left_semi").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")))
    return stored.join(known, F.col("refers_id") == F.col("_id"), "left").drop("_id")
