"""Converts legacy ARC archives to WARC.

An ARC file starts with a version block (``filedesc://``) whose second line says which fields the URL
record lines hold: five in version 1, ten in version 2. Each record is such a line, then as many bytes as
its last field declares, then a line feed. The converter walks a file by these lengths, never by searching
for a next header, and makes a WARC/1.1 record of each: identifier, timestamp, target, type and digests.

Records with equal payloads of at least ``min_revisit`` bytes become one response and revisits of it. Only
(key, length, digest) travel to find the largest key of each payload; the payloads themselves are parsed
again from the archive when the WARC files are written, beside the few columns found.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.shared import bounded_batches, new_path, written

FILE_BYTES = 4_000_000
MIN_REVISIT = 1000
#: Fixed values of the ARC format: field names of the two versions, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRAWLED = "20240101000000"
KEY_HEADER = "X-Record-Key"


# ---------------------------------------------------------------- files of one row each


def _write(contents: DataFrame, path: str) -> None:
    """One gzip file for each row of ``contents`` (content: binary without its last line feed), in any file system of Spark."""
    lines = contents.select(F.col("content").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of each file below ``path``, still compressed."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _inflate(content: pa.Scalar) -> bytes:
    import gzip

    data = content.as_py()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _files(batches, head, record, size: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Joins ``record(row)`` of all rows to files of about ``size`` bytes that start with ``head(number)``; drops each file's last byte."""
    parts, length, number = [], 0, 0
    for batch in batches:
        for row in zip(*batch.columns):
            data = record(*(x.as_py() for x in row))
            if not parts:
                parts, length = [head(number)], 0
            parts.append(data)
            length += len(data)
            if length >= size:
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["content"])
                parts, number = [], number + 1
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["content"])


# ---------------------------------------------------------------- ARC


def write_arc(pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Writes ARC files below ``path``: tasks of even number in version 1, of odd number in version 2.

    A null body counts as empty; a null URL is written as ``-``; characters that a header line can't hold
    are percent-encoded. The key travels as an HTTP header of the archived response (none for null).
    """
    from pyspark.taskcontext import TaskContext

    def run(batches):
        version = 1 + TaskContext.get().partitionId() % 2

        def head(number):
            block = f"{version} 0 ledgerlake\n{ARC_FIELDS[version]}\n".encode()
            name = f"filedesc://part-{TaskContext.get().partitionId()}-{number}.arc"
            extra = "" if version == 1 else "200 - - 0 - "
            return f"{name} 0.0.0.0 {CRAWLED} text/plain {extra}{len(block)}\n".encode() + block + b"\n"

        def record(key, url, body):
            data = (body or "").encode()
            named = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{named}Content-Length: {len(data)}\r\n\r\n".encode() + data
            target = quote(url or "-", safe="%/:=&?~#+!$,;'@()*[]")
            extra = "" if version == 1 else "200 - - 0 - "
            return f"{target} 0.0.0.0 {CRAWLED} text/html {extra}{len(block)}\n".encode() + block + b"\n"

        yield from _files(batches, head, record)

    rows = pages.select(F.col(key_col).cast("long"), F.col(url_col).cast("string"), F.col(body_col).cast("string"))
    _write(rows.mapInArrow(run, "content binary"), path)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an ARC file, the version block left out."""
    names, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line has no end")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line:  # line feeds between records
            at = end + 1
            continue
        values = line.split(" ")
        if not values[-1].isdigit() or end + 1 + int(values[-1]) > len(data):
            raise ValueError(f"an ARC record declares no length that fits: {line[:100]}")
        block = data[end + 1 : end + 1 + int(values[-1])]
        if names is None:
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0]) if lines[0][:1].isdigit() else 0
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version block: {lines[0][:100]}")
            names = (lines[1].strip() if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version]).split(" ")
        else:
            if len(values) > len(names):  # spaces in the URL: the other fields hold none
                spare = len(values) - len(names)
                values = [" ".join(values[: spare + 1]), *values[spare + 1 :]]
            yield dict(zip(names, values)), block
        at = end + 1 + len(block)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP response; a block without a head is all payload."""
    if block.startswith(b"HTTP/"):
        found = re.search(rb"\r?\n\r?\n", block)
        if found:
            return block[: found.end()], block[found.end() :]
    return b"", block


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


# ---------------------------------------------------------------- WARC


def record_id(key: int) -> str:
    """The identifier of the record of ``key``: a custom (version 8) UUID that holds the key's 64 bits."""
    bits = key & ((1 << 64) - 1)
    return uuid.UUID(int=(bits >> 16 << 80) | (8 << 76) | ((bits >> 4 & 0xFFF) << 64) | (0b10 << 62) | (bits & 0xF)).urn


def key_of(identifier: str) -> int:
    """The key of which ``record_id`` made ``identifier``."""
    number = uuid.UUID(identifier.strip("<>")).int
    bits = (number >> 80 & ((1 << 48) - 1)) << 16 | (number >> 64 & 0xFFF) << 4 | number & 0xF
    return bits - (1 << 64) if bits >> 63 else bits


def _warc(fields: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _moment(arc_date: str) -> str:
    """An ARC date (14 digits, or 12 or 8 in old files) in the form of WARC."""
    return datetime.strptime(arc_date.ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def to_warc_record(fields: dict[str, str], block: bytes, refers_to: int | None = None) -> bytes:
    """The WARC record of an ARC record; a revisit of the record with key ``refers_to`` if given.

    A block without an HTTP head (as of ``dns:`` and ``ftp:`` URLs) is a resource, all of it payload. A record
    whose HTTP head names no key gets an identifier from its URL, date and digest.
    """
    head, payload = split_http(block)
    key, digest = _header(head, KEY_HEADER), hashlib.sha1(payload).digest()
    own = record_id(int(key)) if key else uuid.uuid5(uuid.NAMESPACE_URL, f"{fields['URL']} {fields['Archive-date']} {digest.hex()}").urn
    kept = head if refers_to is not None else block
    out = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if head else "resource",
        "WARC-Record-ID": f"<{own}>",
        "WARC-Date": _moment(fields["Archive-date"]),
        "WARC-Target-URI": fields["URL"],
        "WARC-IP-Address": fields["IP-address"],
        "Content-Type": "application/http; msgtype=response" if head else fields["Content-type"],
        "WARC-Payload-Digest": _base32(digest),
        "WARC-Block-Digest": _base32(hashlib.sha1(kept).digest()),
    }
    if refers_to is not None:
        out |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record_id(refers_to)}>", "WARC-Truncated": "length"}
    return _warc(out, kept)


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Converts the ARC files below ``arc_path`` to WARC files below ``warc_path``.

    Of records with equal payloads (length and SHA-1) of at least ``min_revisit`` bytes, that with the
    largest key is the response and the others revisit it; all other records, and those without a key,
    are responses, or resources where they have no HTTP head. A damaged file raises ValueError.
    """
    files = _contents(spark, arc_path)

    def survey(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for number, (_, block) in enumerate(arc_records(_inflate(content))):
                    head, payload = split_http(block)
                    key = _header(head, KEY_HEADER)
                    rows.append((name, number, int(key) if key else None, len(payload), hashlib.sha1(payload).digest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["path", "number", "key", "size", "digest"])

    seen = written(files.mapInArrow(survey, "path string, number int, key long, size long, digest binary").where(f"size >= {int(min_revisit)} and key is not null"), "payloads")
    first = seen.groupBy("size", "digest").agg(F.max("key").alias("response"), F.count("*").alias("n")).where("n > 1")
    revisits = seen.join(first, ["size", "digest"]).where("key < response").select("path", "number", "response")
    by_file = revisits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("number", "response"))).alias("revisits"))  # as many as a file holds
    by_file = written(by_file, "revisits")

    def rewrite(batches):
        def info(number):
            text = "software: ledgerlake\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n".encode()
            made = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {number}").urn
            return _warc({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{made}>", "WARC-Date": _moment(CRAWLED), "Content-Type": "application/warc-fields"}, text)

        number = 0
        for batch in batches:
            for content, found in zip(batch.column(0), batch.column(1).to_pylist()):
                to = {x["number"]: x["response"] for x in found or []}
                records = [to_warc_record(f, b, to.get(i)) for i, (f, b) in enumerate(arc_records(_inflate(content)))]
                if records:
                    yield pa.RecordBatch.from_arrays([pa.array([(info(number) + b"".join(records))[:-1]], pa.binary())], ["content"])
                    number += 1

    both = files.join(by_file, "path", "left").select("content", "revisits")
    _write(both.mapInArrow(rewrite, "content binary"), warc_path)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, url, record_type, payload_bytes, payload_digest, refers_to, payload) of the WARC files below ``path``.

    payload_digest is lower-case hexadecimal SHA-1. A revisit holds no payload: its length is the HTTP
    head's Content-Length, its digest the header's. refers_to is the key of the response, null for others.
    """

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in warc_records(_inflate(content)):
                    kind = fields["WARC-Type"]
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    head, payload = split_http(block)
                    key = _header(head, KEY_HEADER)
                    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
                    if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: its payload doesn't match its digest")
                    size = len(payload) if kind != "revisit" else int(_header(head, "Content-Length") or 0)
                    to = key_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    rows.append((int(key) if key else None, fields["WARC-Target-URI"], kind, size, digest, to, payload if kind != "revisit" else None))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    schema = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return _contents(spark, path).select("content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) as ARC, converts that to WARC and reads it back, without payloads.

    Repeated rows with one page_id and one payload are all responses, as none has a larger key. Other columns of
    ``pages`` are left aside, whatever their names; no pages give no rows. A page of any length is one record, so a
    task must hold the longest page a few times over.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, min_revisit)
    return read(spark, warc).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
