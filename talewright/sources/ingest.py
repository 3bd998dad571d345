"""Files to canonical events: listing, archives, detection, parsing, identity, redaction."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Limits
from ..functions.ids import conversation_key, event_identity, id_of
from ..functions.parts import MAX_INLINE, PART, content_fingerprint, utf8_prefix
from ..functions.redact import canonical_json, scrub, scrub_json
from ..sinks import files
from . import archives

#: Records, and bytes of their texts, in a batch that a task gives back.
BATCH_RECORDS, BATCH_BYTES = 2000, 8 << 20
SKIP_DIRS = {".git", "node_modules", "__pycache__", ".venv", "target", "cache", "caches"}

_S, _L = T.StringType(), T.LongType()
HIT = T.StructType([T.StructField("kind", _S), T.StructField("count", _L)])
DRAFT = T.StructType(
    [T.StructField(n, _S) for n in ("source_path", "chain", "file_path", "parser", "parser_version", "provider", "application", "outcome", "error", "role", "event_type", "native_id", "parent_native_id", "timestamp_original", "timestamp_confidence", "conversation_native", "session_native", "title", "model", "agent", "cwd", "branch", "metadata")]
    + [T.StructField("record", _L), T.StructField("place", _L), T.StructField("ts_ns", _L), T.StructField("content", T.ArrayType(PART)), T.StructField("redactions", T.ArrayType(HIT))]
)


def survey(root: str, limits: Limits = Limits()) -> Iterator[tuple[str, int, int, str | None]]:
    """(path, size, mtime in ns, problem) of what lies below a root, in sorted order.

    Links, empty and oversize files, unwanted extensions and LevelDB stores (one entry each, with the bytes of their files)
    have a problem and aren't read; links and skipped folders aren't followed.
    """
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if os.path.isfile(root):
        s = os.stat(root)
        yield os.path.abspath(root), s.st_size, s.st_mtime_ns, "empty" if not s.st_size else "oversize" if s.st_size > limits.max_file_bytes else None
        return
    count = 0
    base = os.path.abspath(root)
    for folder, dirs, files in os.walk(base):
        depth = folder[len(base) :].count(os.sep)
        if "CURRENT" in files and any(f.startswith("MANIFEST-") for f in files):
            s = os.stat(folder)
            yield folder, sum(os.lstat(os.path.join(folder, f)).st_size for f in files), s.st_mtime_ns, "leveldb"
            dirs[:] = []
            continue
        for d in sorted(dirs):
            if os.path.islink(os.path.join(folder, d)):
                yield os.path.join(folder, d), 0, os.lstat(os.path.join(folder, d)).st_mtime_ns, "link"
        dirs[:] = sorted(d for d in dirs if d.lower() not in SKIP_DIRS and not os.path.islink(os.path.join(folder, d))) if depth < limits.max_depth else []
        for name in sorted(files):
            path = os.path.join(folder, name)
            count += 1
            if count > limits.max_files:
                raise ValueError(f"{root}: more than {limits.max_files} files")
            s = os.lstat(path)
            ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
            problem = "link" if os.path.islink(path) else "empty" if not s.st_size else "oversize" if s.st_size > limits.max_file_bytes else "extension" if ext in limits.skip_extensions else None
            if problem == "extension":  # an archive is one whatever it is called
                with open(path, "rb") as f:
                    problem = None if archives.classify(f.read(512)) else problem
            yield path, s.st_size, s.st_mtime_ns, problem


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime in ns) of the files below a root that are read."""
    return ((path, size, mtime) for path, size, mtime, problem in survey(root) if problem is None)


def listing(spark: SparkSession, roots: list[str], limits: Limits = Limits()) -> DataFrame:
    """(path, size, mtime_ns, problem, fingerprint, source_id) of all files; only names go through the driver."""
    rows = sorted({r for root in sorted(set(roots)) for r in survey(root, limits)}, key=lambda r: r[0])
    df = spark.createDataFrame(rows, "path string, size long, mtime_ns long, problem string")
    return df.withColumn("fingerprint", id_of("ff_", F.col("path"), F.col("size").cast("string"), F.col("mtime_ns").cast("string"))).withColumn("source_id", id_of("src_", F.col("path")))


def source_name() -> F.Column:
    """What a source is called: its path, below the archives that hold it."""
    return F.when(F.col("chain") == "", F.col("source_path")).otherwise(F.concat_ws("/", "chain", "source_path"))


def file_of() -> F.Column:
    """The file on disk that holds a source."""
    return F.when(F.col("chain") == "", F.col("source_path")).otherwise(F.col("file_path"))


def local(folder: str) -> str:
    """The mounted path of a folder."""
    return re.sub(r"^file:/*", "/", folder)


def _redact(parts: list[dict], keep: bool) -> tuple[list[dict], list[dict]]:
    """Texts and JSON of messages, reasoning, calls, results and raw records; data, images, files and notes stay."""
    import json

    counts: dict[str, int] = {}

    def add(found: dict[str, int]) -> None:
        for k, n in found.items():
            counts[k] = counts.get(k, 0) + n

    for p in parts:
        if p["type"] in ("text", "reasoning"):
            p["text"], found = scrub(p["text"], keep)
            add(found)
        for name in ("arguments_json", "output_json", "raw_json"):
            if p.get(name):
                value, found = scrub_json(json.loads(p[name]), keep)
                if found:
                    p[name] = canonical_json(value)
                add(found)
    return parts, [{"kind": k, "count": n} for k, n in sorted(counts.items())]


def drafts(files: DataFrame, *, only: str | None = None, keep_secrets: bool = False) -> DataFrame:
    """A row for each record of files(path, content), or of files(path) on disk: event, skipped or failed; a file that no parser takes is one skipped row.

    A file is read by one task, as its records depend on each other; archives' members are files of their own. A task holds
    one file at a time and the records of BATCH_RECORDS or BATCH_BYTES.
    """
    from . import registry

    names = [f.name for f in PART.fields]
    given = "content" in files.columns

    def of_file(chain: tuple[str, ...], path: str, raw: bytes) -> Iterator[dict]:
        base = {"source_path": path, "chain": "/".join(chain)}
        found = registry.detect(path, raw, only)
        if not found:
            known = registry.unsupported(path, raw)
            yield base | {"outcome": "skipped", "error": f"{known[0]}: {known[1]}" if known else "no parser", "record": -1, "place": 0}
            return
        p = found[0][0]
        base |= {"parser": p.id, "parser_version": p.version, "provider": p.provider, "application": p.application}
        place = -1
        try:
            for place, d in enumerate(p.parse(path, raw)):
                if d["outcome"] == "event":
                    content, hits = _redact(d["content"], keep_secrets)
                    d = d | {"content": [{n: c.get(n) for n in names} for c in content], "redactions": hits}
                yield base | d | {"place": place}
        except Exception as e:  # what came before a failure stays
            yield base | {"outcome": "failed", "error": f"{type(e).__name__}: {e}", "record": -1, "place": place + 1}

    def of_path(path: str, raw: bytes) -> Iterator[dict]:
        try:
            for m in archives.members(path, raw):
                if m.data is None:
                    yield {"source_path": m.path, "chain": "/".join(m.chain), "file_path": path, "outcome": "failed", "error": m.error, "record": -1, "place": 0}
                    continue
                for d in of_file(m.chain, m.path, m.data):
                    yield d | {"file_path": path}
        except Exception as e:
            yield {"source_path": path, "chain": "", "file_path": path, "outcome": "failed", "error": f"{type(e).__name__}: {e}", "record": -1, "place": 0}

    arrow = to_arrow_schema(DRAFT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                path = batch.column(0)[k].as_py()
                raw = batch.column(1)[k].as_py() if given else Path(path).read_bytes()
                for d in of_path(path, raw):
                    out.append(d)
                    size += sum(len(v) for c in d.get("content") or () for v in c.values() if isinstance(v, str))
                    if len(out) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("path", *["content"] * given).mapInArrow(run, DRAFT)


def read_listed(listed: DataFrame, **options: object) -> DataFrame:
    """drafts() of the files of a listing. Tasks open the files themselves, many small ones each; the driver sees their number and size only."""
    of = listed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return drafts(files.spread(listed.select("path"), "path", of.n, of.size), **options)


def read(spark: SparkSession, roots: list[str], **options: object) -> DataFrame:
    """drafts() of all files below the roots."""
    return read_listed(listing(spark, roots).where("problem is null"), **options)


def _output_text(p: F.Column) -> F.Column:
    """A tool's output as text: a string's own signs, other JSON as it is written."""
    raw = p["output_json"]
    return F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)


def _long_text(p: F.Column, max_inline: int) -> F.Column:
    """The text of a message or a tool's output that is over the limit, else null."""
    text = F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool_result", _output_text(p))
    return F.when(F.octet_length(text) > max_inline, text) if max_inline else F.lit(None).cast("string")


def spilled(draft: DataFrame, *, max_inline: int = MAX_INLINE) -> DataFrame:
    """(sha256, text, source_path) of every text and tool output that events() shortens, in full."""
    texts = draft.where("outcome = 'event'").select("source_path", F.explode(F.transform("content", lambda p: _long_text(p, max_inline))).alias("text")).where("text is not null")
    return texts.select(F.sha2("text", 256).alias("sha256"), "text", "source_path")


def with_whole_texts(events: DataFrame, folder: str) -> DataFrame:
    """events with shortened texts and outputs put back, read from the artifacts in `folder`."""
    if not os.path.isdir(f"{folder}/sha256"):
        return events
    long = F.filter("content", lambda p: p["truncation"].isNotNull())
    wanted = events.select("event_id", F.explode(F.transform(long, lambda p: p["truncation"])).alias("t")).select("event_id", F.col("t.full_sha256").alias("sha256"), F.col("t.full_bytes").alias("size"))
    blobs = files.read_artifacts(wanted, folder).select("sha256", F.decode("data", "UTF-8").alias("whole"))
    by = wanted.join(blobs, "sha256").groupBy("event_id").agg(F.map_from_entries(F.collect_set(F.struct("sha256", "whole"))).alias("__whole"))

    def put_back(p: F.Column) -> F.Column:
        whole = F.element_at("__whole", p["truncation"]["full_sha256"])
        own = F.col("__whole").isNotNull() & p["truncation"].isNotNull() & whole.isNotNull()
        return p.withField("text", F.when(own & (p["type"] == "text"), whole).otherwise(p["text"])).withField("output_json", F.when(own & (p["type"] == "tool_result"), whole).otherwise(p["output_json"]))

    return events.join(by, "event_id", "left").withColumn("content", F.transform("content", put_back)).drop("__whole")


def events(draft: DataFrame, *, max_inline: int = MAX_INLINE) -> DataFrame:
    """Canonical events of the drafts that are events: keys, sequence, shortened texts and outputs (see spilled), fingerprint and id."""
    e = draft.where("outcome = 'event'")
    e = e.withColumn("source_id", id_of("src_", source_name()))
    # a record without any id belongs to its file
    native = F.coalesce("conversation_native", F.when(F.col("provider") == "unknown", F.col("source_id")))
    e = e.withColumn("conversation_id", conversation_key(F.col("provider"), F.col("application"), native, F.col("session_native"), [F.col("title"), F.col("cwd"), F.col("source_path")]))
    e = e.withColumn("seq", (F.row_number().over(W.partitionBy("source_id", "conversation_id").orderBy("place")) - 1).cast("long"))

    def shorten(p: F.Column) -> F.Column:
        full = _long_text(p, max_inline)
        inline = utf8_prefix(full, max_inline or 1)
        sha = F.sha2(full, 256)
        about = F.struct(sha.alias("full_sha256"), F.octet_length(full).cast("long").alias("full_bytes"), F.octet_length(inline).cast("long").alias("inline_bytes"), F.concat(F.lit("sha256/"), sha).alias("artifact"))
        ref = F.to_json(F.struct(F.struct(F.concat(F.lit("sha256/"), sha).alias("artifact"), F.octet_length(full).cast("long").alias("bytes"), sha.alias("sha256")).alias("artifact_ref"), inline.alias("inline_preview")))
        long = full.isNotNull()
        short = p.withField("truncation", F.when(long, about)).withField("text", F.when(long & (p["type"] == "text"), inline).otherwise(p["text"]))
        return short.withField("output_json", F.when(long & (p["type"] == "tool_result"), ref).otherwise(p["output_json"]))

    e = e.withColumn("content", F.transform("content", shorten)).withColumn("content_fp", content_fingerprint(F.col("content")))
    event_id, tier = event_identity(F.col("provider"), F.col("application"), F.col("conversation_id"), F.col("native_id"), F.col("seq"), F.col("role"), F.col("event_type"), F.col("content_fp"))
    return e.withColumn("identity_tier", tier).withColumn("event_id", event_id)
