"""File sinks: compressed JSON shards, content-addressed artifacts, checksums, deterministic packs."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import io
import itertools
import json
import os
import tarfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PACK_ENTRIES, MAX_PACK_ENTRY, MAX_PACK_TOTAL = 100_000, 2 << 30, 20 << 30
#: Bytes and files that a task reads; bytes and files that it writes before they are synced.
TASK_BYTES, TASK_FILES = 16 << 20, 2000
SYNC_BYTES, SYNC_FILES = 64 << 20, 5000
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "pdf": "application/pdf", "txt": "text/plain", "md": "text/markdown", "json": "application/json", "html": "text/html", "csv": "text/csv", "zip": "application/zip", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/wav"}


def guess_mime(name: F.Column) -> F.Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def write_atomic(path: str | Path, data: bytes, *, synced: bool = True) -> None:
    """Whole or not at all: a temporary file beside it is renamed. What can be made again needs no sync."""
    _write_pieces(path, (data,), synced)


def write_lines(path: str | Path, lines: Iterable[str]) -> None:
    """Lines as they come, into a file that is there whole or not at all."""
    _write_pieces(path, (line.encode() + b"\n" for line in lines))


def _write_pieces(path: str | Path, pieces: Iterable[bytes], synced: bool = True) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}.part")
    try:
        with open(part, "wb") as f:
            for data in pieces:
                f.write(data)
            f.flush()
            if synced:
                os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


class _Hashing:
    """A file that is hashed as it is written."""

    def __init__(self, f):
        self.f, self.sha = f, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self.sha.update(data)
        return self.f.write(data)

    def flush(self) -> None:
        self.f.flush()


def stream_lines(lines: Iterator[str], folder: str, name: str, level: int = 9) -> tuple[str, int, str]:
    """Lines into a compressed file that is renamed to <name>-<digest>.jsonl.zst once it is whole; gives (path, lines, sha256)."""
    import zstandard

    os.makedirs(folder, exist_ok=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}.part"
    count = 0
    try:
        with open(part, "wb") as f:
            out = _Hashing(f)
            with zstandard.ZstdCompressor(level=level).stream_writer(out, closefd=False) as z:
                for line in lines:
                    z.write(line.encode() + b"\n")
                    count += 1
            f.flush()
            os.fsync(f.fileno())
        path = f"{folder}/{name}-{out.sha.hexdigest()[:16]}.jsonl.zst"
        os.replace(part, path)
        return path, count, out.sha.hexdigest()
    finally:
        Path(part).unlink(missing_ok=True)


def compressed(target: str, *, harness: bool, flag: bool | None = None) -> bool:
    """Whether an export is compressed: as told, else by the target's name; the harness's files are, standard output isn't."""
    if flag is not None:
        return flag
    return target != "-" and (target.endswith((".zst", ".zstd")) or harness)


def write_single(df: DataFrame, target: str, *, compress: bool) -> int:
    """The one string column of an ordered frame as one file, or to standard output ("-"); partitions are fetched one after the other."""
    rows = (r[0] for r in df.toLocalIterator(prefetchPartitions=True))
    if target == "-":
        n = 0
        for n, line in enumerate(rows, 1):
            print(line)
        return n
    import zstandard

    part = Path(target).with_name(f".{Path(target).name}.{uuid.uuid4().hex}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    n = 0
    try:
        with open(part, "wb") as f, zstandard.ZstdCompressor(level=9).stream_writer(f, closefd=False) if compress else contextlib.nullcontext(f) as out:
            for n, line in enumerate(rows, 1):
                out.write(line.encode() + b"\n")
        os.replace(part, target)
    finally:
        part.unlink(missing_ok=True)
    return n


def write_shards(df: DataFrame, folder: str, *, level: int = 9) -> DataFrame:
    """df as .jsonl.zst shards with sorted keys, one for each partition; gives (path, records, sha256).

    Shards are named for their partition and content: names keep a sorted frame's order, and a repeated task writes the same
    file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in b.column(0).to_pylist())
        first = next(rows, None)
        if first is None:
            return
        sorted_json = lambda row: json.dumps(json.loads(row), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        name = f"part-{TaskContext.get().partitionId():06d}"
        path, count, sha = stream_lines((sorted_json(r) for r in itertools.chain([first], rows)), folder, name, level)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([sha])], names=["path", "records", "sha256"])

    return df.select(F.to_json(F.struct("*")).alias("j")).mapInArrow(run, "path string, records long, sha256 string")


def read_shards(spark, folder: str, schema) -> DataFrame:
    """Shards' records; a line that is no record has it in _corrupt."""
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl.zst").json(folder)


def spread(rows: DataFrame, key: str, many: int, size: int) -> DataFrame:
    """rows by key in as many tasks as that many files, of that size in all, are worth."""
    least = min(many, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, least, -(-many // TASK_FILES), -(-size // TASK_BYTES)), key)


def write_many(blobs: list[tuple[Path, bytes]]) -> None:
    """Files that are each there whole or not at all: all are written beside their places and synced at once, then renamed."""
    parts: list[tuple[Path, Path]] = []
    try:
        for path, data in blobs:
            path.parent.mkdir(parents=True, exist_ok=True)
            part = path.with_name(f".{path.name}.{uuid.uuid4().hex}.part")
            parts.append((part, path))
            part.write_bytes(data)
        if parts:
            _sync(parts[0][1].parent)
        for part, path in parts:
            os.replace(part, path)
    except BaseException:
        for part, _ in parts:
            part.unlink(missing_ok=True)
        raise


def _sync(folder: Path) -> None:
    """What was written to the folder's file system is on its disk afterwards."""
    fd = os.open(folder, os.O_RDONLY)
    try:
        if ctypes.CDLL(None, use_errno=True).syncfs(fd):
            raise OSError(ctypes.get_errno(), f"{folder} can't be synced")
    except AttributeError:  # a system without it
        os.sync()
    finally:
        os.close(fd)


def _artifact(folder: str, sha: str) -> Path:
    return Path(folder, "sha256", sha[:2], sha)


def store_artifacts(df: DataFrame, folder: str, *, most: int = 512 << 20) -> DataFrame:
    """Distinct blobs of df(data binary) as sha256/aa/<hex>; gives (sha256, size, copied). Larger ones keep their digest only."""
    blobs = df.where("data is not null").select(F.sha2("data", 256).alias("sha256"), "data").dropDuplicates(["sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, new, size = [], [], 0
            for k in range(b.num_rows):
                sha, data = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                copied = len(data) <= most
                if copied and not (path := _artifact(folder, sha)).exists():
                    new.append((path, data))
                    size += len(data)
                rows.append((sha, len(data), copied))
                if size >= SYNC_BYTES or len(new) >= SYNC_FILES:
                    write_many(new)
                    new, size = [], 0
            write_many(new)
            if rows:
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1], pa.int64()), pa.array(c[2])], names=["sha256", "size", "copied"])

    return blobs.mapInArrow(run, "sha256 string, size long, copied boolean")


def read_artifacts(wanted: DataFrame, folder: str) -> DataFrame:
    """(sha256, data) of those of wanted(sha256, size) that are stored. Tasks open them by name, many each."""
    of = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["sha256", "data"])
        out, size = [], 0
        for b in batches:
            for sha in b.column(0).to_pylist():
                with contextlib.suppress(FileNotFoundError):
                    data = _artifact(folder, sha).read_bytes()
                    out.append((sha, data))
                    size += len(data)
                if size >= TASK_BYTES:
                    yield give(out)
                    out, size = [], 0
        yield give(out)

    # spread before they are made distinct: the other way round the tasks of the first shuffle stay, which follow the bytes of names
    return spread(wanted.select("sha256"), "sha256", of.n, of.size).distinct().mapInArrow(run, "sha256 string, data binary")


def stored_artifacts(spark, folder: str) -> DataFrame:
    """(name, sha256, size) of all artifacts that are there, with the digest of what they hold; a task lists and reads whole folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                own = Path(folder, "sha256", f"{k:02x}")
                rows = []
                for path in sorted(own.iterdir()) if own.is_dir() else ():
                    if not path.name.startswith("."):
                        with open(path, "rb") as f:
                            rows.append((path.name, hashlib.file_digest(f, "sha256").hexdigest(), path.stat().st_size))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["name", "sha256", "size"])

    return spark.range(0, 256, 1, 256).mapInArrow(run, "name string, sha256 string, size long")


SKIPPED = ("SHA256SUMS", "index/", ".staging/")


def checksums(spark, folder: str) -> DataFrame:
    """(path, sha256) of a dataset's files but the list itself, indexes and staging, by path."""
    root = str(Path(folder).resolve())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load("file://" + root)
    rel = F.substring(F.regexp_replace("path", "^file:/*", "/"), len(root) + 2, 100_000)
    out = files.select(rel.alias("path"), F.sha2("content", 256).alias("sha256"))
    return out.where(~F.exists(F.array(*[F.lit(s) for s in SKIPPED]), lambda s: F.col("path").startswith(s))).orderBy("path")


def pack(folder: str, target: str) -> str:
    """The folder as a tar in zstd that depends on its content alone; gives its SHA-256."""
    import zstandard

    root = Path(folder)
    files = sorted(p for p in root.rglob("*") if p.is_file() and not p.is_symlink())
    listed = {p.relative_to(root).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        manifest = json.dumps(listed, sort_keys=True).encode()
        for name, data in [("PACK.json", manifest), *((p.relative_to(root).as_posix(), p.read_bytes()) for p in files)]:
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o644
            t.addfile(info, io.BytesIO(data))
    data = zstandard.ZstdCompressor(level=9).compress(out.getvalue())
    write_atomic(target, data)
    return hashlib.sha256(data).hexdigest()


def unpack(source: str, target: str, *, force: bool = False) -> list[str]:
    """The pack's files, once all are there and right; nothing is published otherwise."""
    import shutil

    import zstandard

    from ..sources.archives import safe_path

    if os.path.exists(target) and os.listdir(target) and not force:
        raise FileExistsError(target)
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(Path(source).read_bytes())
    files: dict[str, bytes] = {}
    total = 0
    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
        for info in t:
            if not info.isreg() or len(files) >= MAX_PACK_ENTRIES or info.size > MAX_PACK_ENTRY:
                raise ValueError(f"{info.name}: not a plain file, or a limit was passed")
            total += info.size
            if total > MAX_PACK_TOTAL:
                raise ValueError("the pack is too large")
            files[safe_path(info.name)] = t.extractfile(info).read()
    listed = json.loads(files.pop("PACK.json"))
    if {n: hashlib.sha256(d).hexdigest() for n, d in files.items()} != listed:
        raise ValueError("the pack's files aren't those of its list")
    staging = f"{target.rstrip('/')}.{uuid.uuid4().hex}.part"
    try:
        for n, d in files.items():
            write_atomic(Path(staging, n), d)
        os.makedirs(staging, exist_ok=True)
        shutil.rmtree(target, ignore_errors=True)
        os.replace(staging, target)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return sorted(files)
