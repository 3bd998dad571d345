"""WARC archives in ZIP packages: a writer, and a reader that never extracts.

A package holds ``archive/data.warc.gz`` (one gzip member for each record) and
``indexes/index.jsonl`` as stored members. The reader parses the central directory, ZIP64 records included,
finds both members, and range-reads single records at their place in the package file.

Of records with equal payloads of at least `least` bytes the one with the smallest key is a
response, the others are revisits that refer to it and carry no payload.

Cases: a null payload is empty; null keys come last, so that a revisit may have none; if all keys of equal
payloads are null, all are responses, as are repeated rows of the smallest key. Signs in a URL that would end a header are
percent-encoded. An empty table writes no package. Package names are unique to the task's attempt, and only those
of attempts that succeeded are listed: a repeated task leaves a file that is never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, local_path, quoted, scratch

DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Compressed bytes of a package that are read in a run, and about as many as a task reads.
RUN_BYTES = 1 << 20
TASK_BYTES = 32 << 20
PACKAGE_BYTES = 64 << 20
_NAMES = uuid.UUID("5b0f6c52-3f0a-4f4e-8f3a-0c8d6f1f7a11")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex40: Column) -> Column:
    """A SHA-1 in hex as bare base32: 5 hex digits are 4 signs."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    signs = []
    for k in range(8):
        number = F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 10).cast("int")
        signs += [F.substring(F.lit(alphabet), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*signs)


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record_id(key: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, str(key))}>"


def record(key: object, url: str, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(key),
        "WARC-Date": DATE,
        "WARC-Target-URI": _clean(url),
        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "WARC-Truncated": "length", "X-Refers-To-Key": _clean(str(refers_to))}
    if key is not None:
        head["X-Record-Key"] = _clean(str(key))
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one WARC record."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(head["content-length"])]
    if len(body) != int(head["content-length"]):
        raise ValueError("a WARC record is cut short")
    return head, body.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else body


@dataclass(frozen=True)
class Member:
    """A member of a ZIP file: where its data are, and how."""

    name: str
    method: int
    stored: int
    size: int
    header: int


def directory(f: BinaryIO) -> list[Member]:
    """The members by the central directory, read from the end of the file."""
    f.seek(0, os.SEEK_END)
    end = f.tell()
    back = min(end, 65_557)
    f.seek(end - back)
    tail = f.read(back)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no ZIP directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
        f.seek(end - back + at - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            wide = f.read(56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 directory where its locator points")
            count, size, start = struct.unpack_from("<QQQ", wide, 32)
    f.seek(start)
    data = f.read(size)
    out: list[Member] = []
    p = 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the ZIP directory is damaged")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        stored, full, n, m, k = struct.unpack_from("<IIHHH", data, p + 20)
        header = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = data[p + 46 + n : p + 46 + n + m]
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            if tag == 1:
                q = 4
                if full == 0xFFFFFFFF:
                    full, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if stored == 0xFFFFFFFF:
                    stored, q = struct.unpack_from("<Q", extra, q)[0], q + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, q)[0]
            extra = extra[4 + length :]
        out.append(Member(name, method, stored, full, header))
        p += 46 + n + m + k
    return out


def data_start(f: BinaryIO, member: Member) -> int:
    """Where a member's data begin, by its own header."""
    f.seek(member.header)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name}: no member where the directory points")
    n, m = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n + m


def index_of(f: BinaryIO) -> list[tuple[int, int]]:
    """(place in the package file, length) of every record: by the stored indexes, else by a walk through the archives."""
    members = {m.name: m for m in directory(f)}
    archives = {n: m for n, m in members.items() if n.startswith("archive/")}
    out: list[tuple[int, int]] = []
    listed: set[str] = set()
    for name, m in members.items():
        if not name.startswith("indexes/") or not name.endswith(".jsonl"):
            continue
        start = data_start(f, m)
        f.seek(start)
        raw = f.read(m.stored)
        for line in (raw if m.method == 0 else zlib.decompress(raw, -15)).splitlines():
            x = json.loads(line)
            out.append((x["filename"], x["offset"], x["length"]))
            listed.add(x["filename"])
    bases = {}
    for name, m in archives.items():
        if m.method:
            raise ValueError(f"{name}: archives must be stored, not compressed again")
        bases[name] = data_start(f, m)
    places = [(bases[n] + o, length) for n, o, length in out]
    for name in archives.keys() - listed:
        places += _walk(f, bases[name], archives[name].stored)
    return places


def _walk(f: BinaryIO, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Bounds of the gzip members in a stored archive without an index."""
    at, stop = start, start + size
    while at < stop:
        f.seek(at)
        one, used = zlib.decompressobj(31), 0
        while not one.eof:
            piece = f.read(min(1 << 16, stop - at - used))
            if not piece:
                raise ValueError("an archive is cut short")
            one.decompress(piece)
            used += len(piece) - len(one.unused_data)
        yield at, used
        at += used


class Package:
    """A package being built in memory, up to PACKAGE_BYTES of records."""

    def __init__(self) -> None:
        self.archive, self.index = io.BytesIO(), []

    def add(self, data: bytes, about: dict) -> None:
        start = self.archive.tell()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.archive.write(z.compress(data) + z.flush())
        self.index.append(about | {"filename": ARCHIVE, "offset": start, "length": self.archive.tell() - start})

    def write(self, folder: str) -> str:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.wacz"
        with zipfile.ZipFile(path + ".part", "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            z.writestr(INDEX, "".join(json.dumps(x) + "\n" for x in self.index))
            with z.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as m:
                m.write(self.archive.getbuffer())
            z.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        os.replace(path + ".part", path)
        return path


def write(df: DataFrame, folder: str, *, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for each row into packages in `folder` (on a share that all executors mount); gives their paths."""
    payload = F.coalesce(quoted(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(quoted(key_col).alias("key"), F.coalesce(quoted(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    # verdicts are found on keys and digests alone; payloads then meet theirs by key, so copies of one payload don't meet in a task
    narrow = pages.where(F.octet_length("payload") >= least).select("key", "sha")
    first = narrow.groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    again = narrow.join(first, "sha").where(~F.col("key").eqNullSafe(F.col("first"))).distinct()
    mine = again.select(F.col("key").alias("k"), F.col("sha").alias("s"), "first")
    rows = pages.join(mine, F.col("key").eqNullSafe(F.col("k")) & (F.col("sha") == F.col("s")), "left")
    rows = rows.select("key", F.col("first").isNotNull().alias("revisit"), "first", "url", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, paths = Package(), []
        for batch in batches:
            for key, revisit, head, url, payload in zip(*(c.to_pylist() for c in batch.columns)):
                package.add(record(key, url, payload, head, revisit), {"urn": record_id(key), "digest": f"sha1:{digest_of(payload)}"})
                if package.archive.tell() >= package_bytes:
                    paths.append((package.write(folder), len(package.index)))
                    package = Package()
        if package.index:
            paths.append((package.write(folder), len(package.index)))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in paths], pa.string()), pa.array([n for _, n in paths], pa.int64())], names=["path", "records"])

    return cut(rows.mapInArrow(run, "path string, records long"), "packages")


def read(packages: DataFrame) -> DataFrame:
    """(path, offset, key, uri, record_type, refers_to, header_digest, payload) of all records of packages(path)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(path, "rb") as f:
                    places = index_of(f)
                for k in range(0, len(places), 10_000):
                    some = places[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array([p for p, _ in some], pa.int64()), pa.array([n for _, n in some], pa.int64())], names=["path", "offset", "length"])

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, BinaryIO] | None = None
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if opened is None or opened[0] != path:
                    if opened:
                        opened[1].close()
                    opened = path, open(path, "rb")
                opened[1].seek(offset)
                head, payload = parse_record(zlib.decompress(opened[1].read(length), 31))
                out.append((path, offset, head.get("x-record-key"), head.get("warc-target-uri"), head["warc-type"], head.get("x-refers-to-key"), head.get("warc-payload-digest", "").removeprefix("sha1:"), payload))
                size += len(payload)
                if size > 8 << 20:
                    yield _records(out)
                    out, size = [], 0
            if out:
                yield _records(out)
        if opened:
            opened[1].close()

    places = cut(packages.select("path").mapInArrow(listed, "path string, offset long, length long"), "places")
    # runs of records of one package stay together, in order; tasks by the bytes to be read, not by the size of their places
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES)
    runs = places.withColumn("run", F.expr(f"offset div {RUN_BYTES}")).repartition(tasks, "path", "run").sortWithinPartitions("path", "offset").drop("run")
    return runs.mapInArrow(fetched, "path string, offset long, key string, uri string, record_type string, refers_to string, header_digest string, payload binary")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "offset", "key", "uri", "record_type", "refers_to", "header_digest", "payload"])


def round_trip(df: DataFrame, **columns: str) -> DataFrame:
    """Write df's records to the shared folder and read them back: read()'s columns, where payload is what each record holds."""
    spark = df.sparkSession
    return read(write(df, local_path(scratch(spark, "warc")), **columns))
