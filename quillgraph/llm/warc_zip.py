"""Operator 1, WARC in ZIP: writes web archives packed in ZIP files, and reads them by range without extraction.

Layout. Each package is a ZIP file of two stored members: `archive/data.warc.gz`, a WARC file whose records are gzip members of
their own, and `indexes/index.cdxj`, a line for each record: page id, offset and length within the member, record type.
The reader takes the end-of-central-directory record from the file's tail (and the ZIP64 one where a field is full), walks
the central directory, finds each stored member's data behind its local header, reads the index by range, and then each
record by range; neighbouring records are read in stretches of READ bytes. Nothing is ever unpacked to disk.

Revisits. Of rows with equal payloads of at least LEAST bytes, those with the smallest id are responses; the others are revisit
records that name it. Digests are SHA-256; a response's digest is taken anew from the bytes read, and the read fails where
it differs from the record's header.

Defined results. A null payload is empty. Rows that repeat an id: all rows with the smallest id of a payload are responses.
Null ids come last in order and are never referred to while another id has the payload; where all ids are null, all are
responses. Empty tables give an empty result. Extra columns aren't read.

Where packages live. Executors write and read packages through pyarrow's file systems, in the cluster's shared folder: a
mounted path, or s3, gs or hdfs where the platform offers them. Each attempt of a task writes names of its own, and only
packages in the table of packages that the write returns are ever read, so lost executors leave no half-written data in
the result. A package ends at PACKAGE bytes, so that a task that reads one has bounded work.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LEAST = 100
PACKAGE = 32 << 20
READ = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
#: Fixed values of the ZIP format: signatures of its records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


# ---- ZIP


class ZipWriter:
    """Stored members, one after the other, to a file object; sizes that fill their fields go to ZIP64 records."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, begin = name.encode(), zlib.crc32(data), self.at
        wide = self.zip64 or len(data) >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = _FULL32 if wide else len(data)
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), begin))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.members:
            fields = [x if not (self.zip64 or x >= _FULL32) else None for x in (size, size, at)]
            wide = [x for x, f in zip((size, size, at), fields, strict=True) if f is None]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            short = [_FULL32 if f is None else f for f in fields]
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 0x21, crc, short[0], short[1], len(raw), len(extra), 0, 0, 0, 0, short[2]) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.zip64 or n >= _FULL16 or size >= _FULL32 or begin >= _FULL32:
            end64 = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, begin = _FULL16, _FULL32, _FULL32
        self._put(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, begin, 0))


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    stored: int
    header: int


def read_at(file, at: int, size: int) -> bytes:
    data = file.read_at(size, at)
    if len(data) != size:
        raise ValueError(f"the file ends at {at + len(data)}, before {at + size}")
    return data


def directory(file) -> list[Member]:
    """The central directory of a ZIP file; file: read_at(size, offset) and size()."""
    size = file.size()
    tail = read_at(file, max(0, size - 22 - _FULL16), min(size, 22 + _FULL16))
    k = tail.rfind(END)
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(END, 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    _, _, _, n, length, begin, _ = struct.unpack_from("<HHHHIIH", tail, k + 4)
    end_at = size - len(tail) + k
    if (n == _FULL16 or length == _FULL32 or begin == _FULL32) and end_at >= 20:
        locator = read_at(file, end_at - 20, 20)
        if locator[:4] == LOCATOR64:
            end64 = read_at(file, struct.unpack_from("<IQI", locator, 4)[1], 56)
            if end64[:4] != END64:
                raise ValueError("no ZIP64 end of central directory where its locator points")
            n, length, begin = struct.unpack_from("<QQQ", end64, 32)
    data, at, out = read_at(file, begin, length), 0, []
    for _ in range(n):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        _, _, _, method, _, _, crc, stored, real, a, b, c, _, _, _, header = struct.unpack_from("<HHHHHHIIIHHHHHII", data, at + 4)
        name, extra = data[at + 46 : at + 46 + a], data[at + 46 + a : at + 46 + a + b]
        at += 46 + a + b + c
        k = 0
        while k + 4 <= len(extra):
            kind, own = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = [x for (x,) in struct.iter_unpack("<Q", extra[k + 4 : k + 4 + own - own % 8])]
                real = wide.pop(0) if real == _FULL32 else real
                stored = wide.pop(0) if stored == _FULL32 else stored
                header = wide.pop(0) if header == _FULL32 else header
            k += 4 + own
        out.append(Member(name.decode("utf-8", "replace"), method, crc, real, stored, header))
    return out


def member_at(file, member: Member) -> int:
    """Where a stored member's data begins."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = read_at(file, member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header where the directory points")
    a, b = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + a + b


# ---- WARC


def record(kind: str, page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC record as a gzip member of its own. A revisit keeps the payload's digest and length, not its bytes."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    target = "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in (url or "").encode())
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {time.strftime('%Y-%m-%dT%H:%M:%SZ', time.gmtime())}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {refers_to}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record's gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_package(path: str, read: int = READ) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a package, read by range through its index."""
    fs, name = file_system(path)
    with fs.open_input_file(name) as file:
        members = {m.name: m for m in directory(file)}
        index, data = members[INDEX], members[DATA]
        rows = [json.loads(x.partition(b" ")[2]) for x in read_at(file, member_at(file, index), index.size).splitlines()]
        rows.sort(key=lambda r: r["offset"])
        begin, k = member_at(file, data), 0
        while k < len(rows):
            to = k + 1
            while to < len(rows) and rows[to]["offset"] + rows[to]["length"] - rows[k]["offset"] <= read:
                to += 1
            low = rows[k]["offset"]
            held = read_at(file, begin + low, rows[to - 1]["offset"] + rows[to - 1]["length"] - low)
            for r in rows[k:to]:
                yield parse_record(held[r["offset"] - low : r["offset"] - low + r["length"]])
            k = to


class PackageWriter:
    """Packages of about most bytes in a folder; names hold a mark of the attempt."""

    def __init__(self, folder: str, most: int = PACKAGE, zip64: bool = False):
        self.folder, self.most, self.zip64 = folder, most, zip64
        self.data, self.index, self.size, self.done = [], [], 0, []

    def add(self, kind, page_id, url, payload, digest, refers_to) -> None:
        data = record(kind, page_id, url, payload, digest, refers_to)
        self.index.append(f"{json.dumps(page_id)} " + json.dumps({"offset": self.size, "length": len(data), "type": kind}))
        self.data.append(data)
        self.size += len(data)
        if self.size >= self.most:
            self.close()

    def close(self) -> None:
        if not self.data:
            return
        fs, folder = file_system(self.folder)
        name = f"{uuid.uuid4().hex}.wacz"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{name}") as out:
            z = ZipWriter(out, self.zip64)
            z.add(DATA, b"".join(self.data))
            z.add(INDEX, "\n".join(self.index).encode())
            z.close()
        self.done.append((f"{self.folder}/{name}", len(self.data), self.size))
        self.data, self.index, self.size = [], [], 0


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, zip64: bool = False, most: int = PACKAGE) -> DataFrame:
    """Writes all rows; the table of packages: (package, records, bytes)."""
    src = pages.select(shared.whole_id(F.col(id_col)).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    src = src.withColumn("digest", F.sha2("payload", 256)).withColumn("long", F.length("payload") >= least)
    # Counted before it is shuffled; only payloads that may stand more than once (a bounded filter tells) are shuffled for the join.
    again = src.filter("long").groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("original")).filter("n > 1 and original is not null").select("digest", "original")
    again = shared.settle(again, "repeated-payloads")
    some, rest = shared.split_by(src, "digest", shared.fingerprint_filter(again, "digest"))
    rows = some.join(again, "digest", "left").unionByName(rest.withColumn("original", F.lit(None).cast("long"))).withColumn("refers_to", F.when(F.col("long") & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))

    def write(batches):
        out = PackageWriter(folder, most, zip64)
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.add("response" if refers_to is None else "revisit", page_id, url, payload, digest, refers_to)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out.done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["package", "records", "bytes"])

    made = rows.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "package string, records bigint, bytes bigint")
    out = shared.settle(made, "packages")
    shared.discard(again)
    return out


def read_archives(packages: DataFrame, payload: bool = False) -> DataFrame:
    """A row for each record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload of responses if asked for."""

    def number(x: str):
        return None if x == "None" else int(x)

    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for head, body in read_package(path):
                    kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"])
                    if kind == "response":
                        size = len(body)
                        if hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"{path}: the payload of page {head['warc-page-id']} differs from its digest")
                    row = [number(head["warc-page-id"]), head["warc-target-uri"], kind, size, digest, number(head["warc-refers-to-page-id"]) if kind == "revisit" else None]
                    rows.append([*row, body if kind == "response" else None] if payload else row)
                    if len(rows) >= 1000:
                        yield emit(rows)
                        rows = []
                yield emit(rows)

    # A package to a task or few: packages are of bounded size.
    spread = packages.select("package").repartition(max(1, min(packages.count(), 100_000)), "package")
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payload
    return spread.mapInArrow(read, schema)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared.shared_dir(spark)}/quillgraph/warc-{uuid.uuid4().hex}"
    packages = write_archives(shared.table(spark, sf_dir, "pages"), folder)
    return read_archives(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha256(html) as payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as original from d)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when original is not null and page_id is distinct from original then 'revisit' else 'response' end as record_type,
  case when original is not null and page_id is distinct from original then original end as refers_to
from f
"""
