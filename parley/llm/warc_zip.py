"""Operator 2: WARC records in ZIP packages, read by range without extraction.

Writing: every partition packs its records into one ZIP file of stored members:
``archive/*.warc.gz`` (one gzip member for each record), ``indexes/index.cdxj``
and ``datapackage.json``. Files go to a shared folder under names that no other
attempt of the task uses; only the files of successful tasks are in the
returned table, so lost executors and repeated tasks do no harm.

Reading: the end record, its ZIP64 form and the central directory are parsed
from the end of each file, stored members and the index are located, and every
record is then fetched by its own byte range. Records are dealt by file and
range, so a large package is read by many tasks.

Payloads of at least ``least_bytes`` that occur more than once are stored once, with the
row of the smallest id; the others are revisit records that refer to it.

Defined cases: a null payload counts as empty; small payloads are always
responses; repeated rows with the smallest id are each a response; rows with a
null id are written, and refer to the smallest id if their payload has one; a null url leaves its header out;
other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import columns, durable, shared_folder

LEAST_BYTES = 100
MEMBER_BYTES = 16 << 20
SLICE_BYTES = 8 << 20
_DATE = "1970-01-01T00:00:00Z"


def with_references(pages: DataFrame, *, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_digest, record_type, refers_to of every row."""
    base = columns(pages, page_id="long", url="string", html="string").withColumn("payload", F.coalesce("html", F.lit("")).cast("binary")).drop("html")
    base = base.withColumn("payload_digest", F.sha2("payload", 256))
    first = base.filter(F.octet_length("payload") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    out = base.join(first, "payload_digest", "left")
    return out.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("lead")).alias("refers_to"))


def _name(page: int | None) -> str:
    return f"<urn:parley:page:{'' if page is None else page}>"


def _number(name: str | None) -> int | None:
    found = re.search(r"page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def build_record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record whose block is an HTTP response; a revisit has the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page, payload bytes, payload digest, type, page referred to); the digest of a stored payload is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "revisit":
        size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    else:
        size, found = len(payload), hashlib.sha256(payload).hexdigest()
        if found != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} has digest {found}, its header says {digest}")
    return _number(fields["WARC-Record-ID"]), size, digest, kind, _number(fields.get("WARC-Refers-To"))


class Package:
    """Collects records and writes one ZIP file of stored members."""

    def __init__(self, stream, *, member_bytes: int = MEMBER_BYTES, zip64: bool = False) -> None:
        self.zip, self.member_bytes, self.zip64 = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), member_bytes, zip64
        self.data, self.members, self.records, self.index = io.BytesIO(), 0, 0, []

    def _store(self, name: str, data: bytes) -> None:
        with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as member:
            member.write(data)

    def add(self, page: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 1, mtime=0)
        place = {"filename": f"data-{self.members:05d}.warc.gz", "offset": self.data.tell(), "length": len(packed)}
        self.index.append(f"{'' if page is None else page} {json.dumps(place)}\n")
        self.data.write(packed)
        self.records += 1
        if self.data.tell() >= self.member_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.data.tell():
            self._store(f"archive/data-{self.members:05d}.warc.gz", self.data.getvalue())
            self.data, self.members = io.BytesIO(), self.members + 1

    def close(self) -> None:
        self._flush()
        self._store("indexes/index.cdxj", "".join(self.index).encode())
        self._store("datapackage.json", json.dumps({"profile": "data-package", "records": self.records}).encode())
        self.zip.close()


def write_packages(records: DataFrame, folder: str, *, member_bytes: int = MEMBER_BYTES, zip64: bool = False) -> DataFrame:
    """Write all records; returns path and records of each package. The table is durable: reading it does not write again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, package = TaskContext.get(), None
        system, root = fs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip"
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")), strict=True):
                if package is None:
                    system.create_dir(root, recursive=True)
                    stream = system.open_output_stream(f"{root}/{name}")
                    package = Package(stream, member_bytes=member_bytes, zip64=zip64)
                package.add(row[0], build_record(*row))
        if package is not None:
            package.close()
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([package.records], pa.int64())], ["path", "records"])

    return durable(records.mapInArrow(run, "path string, records long"))


@dataclass
class Member:
    name: str
    start: int  # of its data
    size: int


def _tail(file, size: int) -> tuple[int, int, int]:
    """(entries, bytes, offset) of the central directory."""
    file.seek(max(0, size - 65_557))
    tail = file.read(65_557)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    entries, length, offset = struct.unpack_from("<HLL", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":  # the ZIP64 locator comes right before
        file.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        entries, length, offset = struct.unpack_from("<QQQ", file.read(56), 32)
    return entries, length, offset


def stored_members(file, size: int) -> list[Member]:
    """Stored members of an open ZIP file, from its central directory (ZIP64 sizes and offsets included)."""
    entries, length, offset = _tail(file, size)
    file.seek(offset)
    raw, at, out = file.read(length), 0, []
    for _ in range(entries):
        method, packed, plain, n, m, k, header = *struct.unpack_from("<10xHxxxxxxxxLLHHH", raw, at), struct.unpack_from("<L", raw, at + 42)[0]
        name, extra = raw[at + 46 : at + 46 + n].decode(), raw[at + 46 + n : at + 46 + n + m]
        e = 0
        while e + 4 <= len(extra):
            tag, width = struct.unpack_from("<HH", extra, e)
            if tag == 1:  # eight bytes for each field that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{width // 8}Q", extra, e + 4))
                plain, packed, header = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, header))
            e += 4 + width
        at += 46 + n + m + k
        if method == zipfile.ZIP_STORED:
            file.seek(header + 26)
            out.append(Member(name, header + 30 + sum(struct.unpack("<HH", file.read(4))), packed))
    return out


def locate_records(packages: DataFrame) -> DataFrame:
    """path, offset and length (in the ZIP file) of every indexed record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    members = {m.name: m for m in stored_members(file, file.size())}
                    for index in (m for m in members.values() if m.name.startswith("indexes/") and m.name.endswith(".cdxj")):
                        file.seek(index.start)
                        places = [json.loads(line[line.index("{") :]) for line in file.read(index.size).decode().splitlines()]
                        for lo in range(0, len(places), 10_000):
                            part = places[lo : lo + 10_000]
                            yield pa.RecordBatch.from_arrays([pa.array([uri] * len(part)), pa.array([members[f"archive/{p['filename']}"].start + p["offset"] for p in part], pa.int64()), pa.array([p["length"] for p in part], pa.int64())], ["path", "offset", "length"])

    return packages.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(packages: DataFrame, *, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, each fetched by its range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            places, out = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True)), []
            uri, file = None, None
            for path, offset, length in places:
                if path != uri:
                    if file is not None:
                        file.close()
                    system, local = fs.FileSystem.from_uri(path)
                    uri, file = path, system.open_input_file(local)
                file.seek(offset)
                out.append(parse_record(zlib.decompress(file.read(length), 31)))
            if file is not None:
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    places = durable(locate_records(packages))
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    # a task for each slice of archive bytes; by their own size the pointers would all go to a few
    dealt = places.repartition(max(1, -(-int(total) // slice_bytes)), "path", F.floor(F.col("offset") / slice_bytes))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, *, folder: str | None = None, least_bytes: int = LEAST_BYTES, **options) -> DataFrame:
    """Write one record for each page and read all records back."""
    folder = folder or f"{shared_folder(pages)}/warc-{uuid.uuid4().hex}"
    return read_records(write_packages(with_references(pages, least_bytes=least_bytes), folder, **options))
