"""WARC records in ZIP packages: written, located and range-read without extraction.

A package is a ZIP archive whose members are stored, not deflated: one member holds WARC
records, each gzipped on its own, and one holds an index line for each record.  The reader
parses the end record, the ZIP64 records where present and the central directory, reads the
index, and then reads each record by its byte range.

Cases: a null html is an empty payload; a null url leaves out the target; a null page id counts
as less than any other and has an empty identifier; rows that share payload and the largest
page id are all responses; an empty table gives no package and no rows; extra columns are
ignored; one very long page makes a package of its own.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payload bytes that a package gathers; a single page may exceed it.
PACKAGE_BYTES = 4 << 20
#: Payloads of at least so many bytes are stored once and revisited.
REVISIT_BYTES = 0
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- WARC ---------------------------------------------------------------------------------


def _clean(value: str) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def urn(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def page_of(value: str) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") or None


def record(kind: str, page, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; a revisit keeps the response's headers and leaves out its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {urn(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    """First line and the fields, with names in lower case."""
    first, *rest = raw.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return first, fields


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, body = raw.partition(b"\r\n\r\n")
    version, fields = headers(head)
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    block = body[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, headers(http)[1], payload


# --- ZIP ----------------------------------------------------------------------------------

#: Signatures and sizes from the ZIP application note; fixed values.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH"), struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


def zip_stored(members: Iterable[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP archive of stored members; ZIP64 fields are used where needed, or always."""
    out, central, n = io.BytesIO(), [], 0
    for name, data in members:
        raw, at, crc = name.encode(), out.tell(), zlib.crc32(data)
        wide = zip64 or len(data) >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _FULL32 if wide else len(data)
        out.write(_LOCAL.pack(LOCAL, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        far = zip64 or at >= _FULL32
        values = ([len(data)] * 2 if wide else []) + ([at] if far else [])
        extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
        central.append(_CENTRAL.pack(CENTRAL, 45, 45 if wide or far else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, _FULL32 if far else at) + raw + extra)
        n += 1
    start, directory = out.tell(), b"".join(central)
    out.write(directory)
    if zip64 or n >= _FULL16 or start >= _FULL32 or len(directory) >= _FULL32:
        end = out.tell()
        out.write(_END64.pack(END64, _END64.size - 12, 45, 45, 0, 0, n, n, len(directory), start))
        out.write(_LOCATOR.pack(LOCATOR64, 0, end, 1))
    out.write(_END.pack(END, 0, 0, min(n, _FULL16), min(n, _FULL16), min(len(directory), _FULL32), min(start, _FULL32), 0))
    return out.getvalue()


class BytesSource:
    """Ranges of bytes that are in memory, as a column's value is."""

    def __init__(self, data: bytes):
        self.data, self.size = memoryview(data), len(data)

    def read(self, start: int, length: int) -> bytes:
        return bytes(self.data[start : start + length])


class FileSource:
    """Ranges of a file that this machine can open."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.size = self.file.seek(0, io.SEEK_END)

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def directory(source) -> dict[str, Member]:
    """Members by name, from the central directory; ZIP64 values replace those that are full."""
    tail_at = max(0, source.size - _END.size - _FULL16)
    tail = source.read(tail_at, source.size - tail_at)
    at = len(tail) - _END.size
    while at >= 0:
        at = tail.rfind(struct.pack("<I", END), 0, at + 4)
        if at < 0 or at + _END.size + _END.unpack_from(tail, at)[7] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, count, length, start, _ = _END.unpack_from(tail, at)
    spot = tail_at + at - _LOCATOR.size
    if spot >= 0 and (found := _LOCATOR.unpack(source.read(spot, _LOCATOR.size)))[0] == LOCATOR64:
        wide = _END64.unpack(source.read(found[2], _END64.size))
        if wide[0] != END64:
            raise ValueError("broken ZIP64 end record")
        count, length, start = wide[7], wide[8], wide[9]
    raw, members, at = source.read(start, length), {}, 0
    for _ in range(count):
        sig, _, _, _, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, header = _CENTRAL.unpack_from(raw, at)
        if sig != CENTRAL:
            raise ValueError("broken central directory")
        at += _CENTRAL.size
        name, extra = raw[at : at + n_name].decode(), raw[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        spot = 0
        while spot + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, spot)
            if tag == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, spot + 4))
                size = next(values) if size == _FULL32 else size
                packed = next(values) if packed == _FULL32 else packed
                header = next(values) if header == _FULL32 else header
            spot += 4 + n
        members[name] = Member(name, method, crc, packed, size, header)
    return members


def place(source, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    head = _LOCAL.unpack(source.read(member.header, _LOCAL.size))
    if head[0] != LOCAL:
        raise ValueError("broken local header")
    return member.header + _LOCAL.size + head[9] + head[10]


# --- packages -----------------------------------------------------------------------------


class Package:
    """Gathers records; ``finish`` gives the archive."""

    def __init__(self) -> None:
        self.records, self.index, self.held = io.BytesIO(), [], 0

    def add(self, raw: bytes, kind: str, page, digest: str) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.index.append(f"{urn(page)} {kind} sha1:{digest} {self.records.tell()} {len(member)}\n")
        self.records.write(member)
        self.held += len(raw)

    def finish(self, zip64: bool = False) -> bytes:
        return zip_stored([(RECORDS, self.records.getvalue()), (INDEX, "".join(self.index).encode())], zip64)


def read_index(source) -> tuple[int, list[tuple[str, str, str, int, int]]]:
    """Offset of the records' member and (id, type, digest, offset, length) of each record."""
    members = directory(source)
    lines = source.read(place(source, members[INDEX]), members[INDEX].size).decode().splitlines()
    split = [line.rsplit(" ", 4) for line in lines]
    return place(source, members[RECORDS]), [(a, b, c, int(d), int(e)) for a, b, c, d, e in split]


def read_records(source) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Each record of a package, read by its range."""
    base, lines = read_index(source)
    for _, _, _, offset, length in lines:
        yield parse_record(zlib.decompress(source.read(base + offset, length), 31))


def plan(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, sha1 (hex), kind and refers_to for each page.

    Only digests that occur more than once are kept for the join; it has no aggregate above
    its exchanges, so Spark can split a digest that holds many rows.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.where(F.length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    joined = rows.join(common.written(shared, "payloads"), "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first")))
    return joined.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def pack(planned: DataFrame, limit: int = PACKAGE_BYTES) -> DataFrame:
    """One row (``package`` binary) for each archive."""
    common.ship(planned.sparkSession)

    def run(batches):
        package = Package()
        for batch in batches:
            names = ("page_id", "url", "payload", "sha1", "kind", "refers_to")
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for i in range(batch.num_rows):
                page, url, payload, sha1, kind, refers = (c[i].as_py() for c in columns)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                if package.held and package.held + len(payload) > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([package.finish()], pa.binary())], names=["package"])
                    package = Package()
                package.add(record(kind, page, url, payload, digest, refers), kind, page, digest)
        if package.held:
            yield pa.RecordBatch.from_arrays([pa.array([package.finish()], pa.binary())], names=["package"])

    return planned.mapInArrow(run, "package binary")


def unpack(packages: DataFrame, column: str = "package", with_payload: bool = False) -> DataFrame:
    """A row for each record of the packages, from the bytes that are read back."""
    common.ship(packages.sparkSession)
    fields = [("record_id", pa.string(), "string"), ("target", pa.string(), "string"), ("record_type", pa.string(), "string"), ("payload_bytes", pa.int64(), "bigint"), ("payload_digest", pa.string(), "string"), ("refers_to", pa.string(), "string")]
    if with_payload:
        fields.append(("payload", pa.binary(), "binary"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                out: list[list] = [[] for _ in fields]
                for warc, http, payload in read_records(BytesSource(batch.column(0)[i].as_buffer())):
                    kind, digest = warc["warc-type"], warc["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"{warc['warc-record-id']}: payload and digest differ")
                    size = len(payload) if kind == "response" else int(http["content-length"])
                    refers = warc.get("warc-refers-to")
                    row = (page_of(warc["warc-record-id"]), warc.get("warc-target-uri"), kind, size, digest, refers and page_of(refers), payload)
                    for values, value in zip(out, row, strict=False):
                        values.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f[1]) for v, f in zip(out, fields, strict=True)], names=[f[0] for f in fields])

    return packages.select(column).mapInArrow(run, ", ".join(f"{n} {s}" for n, _, s in fields))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    found = unpack(common.written(pack(plan(pages)), "packages"))
    page = pages.schema["page_id"].dataType
    return found.select(F.col("record_id").cast(page).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page).alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT h, max(page_id) AS first FROM p GROUP BY h),
c AS (SELECT page_id, strlen(html) AS n, first,
             list_transform(range(8), lambda i: CAST('0x' || substr(p.h, CAST(i * 5 + 1 AS BIGINT), 5) AS BIGINT)) AS parts
      FROM p JOIN r ON p.h = r.h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> s) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id < first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM c
"""
