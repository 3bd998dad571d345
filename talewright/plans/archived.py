"""The test conversations imported into an archive, and every view, check, export and search over it.

Each conversation is a session file a/conv-<n>/s.jsonl. Of every third there is a copy below b, of every seventh one below c with
another first text, every fourth ends in a broken line, and beside every tenth lie notes that no parser takes. The archive is
made once for a session and set of tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dataset
from ..archive import Archive
from ..config import Config, Limits, Machine, ProjectAlias
from ..lineage import kept
from ..operators import export, export_records, ledger, search, validate
from ..sinks.files import write_atomic
from ..sources import ingest
from .formats import START, conversations, iso
from .records import _ROLE

LIMIT = 300  # bytes of a text that are kept inline
WORDS = "de la"


def _files(c: int, turns: list[dict], folder: str) -> Iterator[tuple[str, bytes]]:
    def line(k: int, role: str, text: str) -> dict:
        kind = "assistant" if role == "assistant" else "user"
        more = {"model": "m1"} if role == "assistant" else {}
        return {"type": kind, "uuid": f"u-{c}-{k}", "parentUuid": f"u-{c}-{k - 1}" if k else None, "sessionId": f"{c:08d}-0000-4000-8000-000000000000", "cwd": f"/work/p{c % 5}", "gitBranch": f"b{c % 2}", "timestamp": iso(c, k) if k % 2 == 0 else None, "message": {"role": role, "content": [{"type": "text", "text": text}], **more}}

    rows = [line(t["turn"], t["role"], t["text"]) for t in turns]
    data = "".join(json.dumps(r) + "\n" for r in rows).encode()
    yield f"{folder}/a/conv-{c}/s.jsonl", data + (b"{broken\n" if c % 4 == 0 else b"")
    if c % 3 == 0:
        yield f"{folder}/b/conv-{c}/s.jsonl", data
    if c % 7 == 0:
        rows[0]["message"]["content"][0]["text"] = f"edited {c}"
        yield f"{folder}/c/conv-{c}/s.jsonl", "".join(json.dumps(r) + "\n" for r in rows).encode()
    if c % 10 == 0:
        yield f"{folder}/a/conv-{c}/notes.txt", b"just notes\n"
        yield f"{folder}/a/conv-{c}/nothing.jsonl", b""


def _write(spark: SparkSession, sf_dir: str, folder: str) -> None:
    where = ingest.local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for k in range(b.num_rows):
                for path, data in _files(b.column(0)[k].as_py(), b.column(1)[k].as_py(), where):
                    write_atomic(path, data, synced=False)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    conversations(spark, sf_dir).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    """The archive of the session for these tables: two imports of the same files, and the dataset."""

    def build(folder: str) -> Archive:
        _write(spark, sf_dir, f"{folder}/files")
        root = ingest.local(f"{folder}/files")
        config = Config(machine=[Machine("desk", [f"{root}/a"]), Machine("lap", [f"{root}/b"])], project_alias=[ProjectAlias("zero", ["/work/p0"])], limits=Limits(max_inline_text_bytes=LIMIT))
        config.secrets.policy = "preserve"
        made = Archive(spark, f"{folder}/archive", config)
        made.import_([root], run="r1")
        made.import_([root], run="r2")
        made.write_dataset()
        return made

    return kept(spark, ("archive", sf_dir), build)


def _conv(col: str = "session_native") -> Column:
    return F.regexp_extract(col, r"(?:^|conv-)(\d+)", 1).cast("long")


def _turn(col: str = "native_id") -> Column:
    return F.regexp_extract(col, r"-(\d+)$", 1).cast("long")


def _kind(col: str = "source_path") -> Column:
    return F.regexp_extract(col, r"/files/([abc])/", 1)


def archive_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two imports of the same files, variants and placed by configuration included."""
    e = archive(spark, sf_dir).need("events")
    t = F.get("content", F.lit(0))
    return e.select(
        _conv().alias("conv_id"), _turn().alias("turn"), "seq", "role", "event_type", F.col("variant_of").isNotNull().alias("variant"), "machine_id", "project_name", "branch", "model", "import_run",
        F.octet_length(t["text"]).cast("long").alias("inline_bytes"), t["truncation"]["full_bytes"].alias("full_bytes"), t["truncation"]["full_sha256"].alias("full_sha256"),
    )


def archive_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each event was seen: file, record and parser, once for two imports."""
    a = archive(spark, sf_dir)
    e = a.need("events").select("event_id", "native_id", F.col("variant_of").isNotNull().alias("variant"))
    return a.need("observations").join(e, "event_id").select(_conv("source_path").alias("conv_id"), _turn().alias("turn"), "variant", _kind().alias("copy"), "record_index", "parser", "import_run")


def archive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    e = a.need("events").select("event_id", "native_id", "session_native")
    return a.need("conflicts").join(e, "event_id").select(_conv().alias("conv_id"), _turn().alias("turn"), F.col("variant_event_id").isNotNull().alias("has_variant"))


def archive_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's account of each file."""
    s = archive(spark, sf_dir).need("sources")
    return s.select(_conv("source_path").alias("conv_id"), F.regexp_extract("source_path", r"([a-z.]+)$", 1).alias("file"), _kind().alias("copy"), "import_run", "examined", "imported", "duplicate", "skipped", "failed", "balanced")


def source_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources over all runs: counters added up, the first known parser, the last status."""
    s = archive(spark, sf_dir).sources()
    return s.select(_conv("source_path").alias("conv_id"), F.regexp_extract("source_path", r"([a-z.]+)$", 1).alias("file"), _kind().alias("copy"), "parser", "status", "examined", "imported", "duplicate", "skipped", "failed")


def conversation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by what their events say first, with the times of their first and last timed event."""
    a = archive(spark, sf_dir)
    names = a.need("events").select("conversation_id", _conv().alias("conv_id")).distinct()
    return a.conversations().join(names, "conversation_id").select("conv_id", "model", "working_directory", F.coalesce("machine_id", F.lit("-")).alias("machine"), "started_ns", "ended_ns", "event_count")


def session_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.sessions(archive(spark, sf_dir).need("events")).select(_conv("native_id").alias("conv_id"), "started_ns", "ended_ns", "event_count")


def machine_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.machines(archive(spark, sf_dir).need("events")).select("machine_id", F.size("evidence").cast("long").alias("evidence"), "event_count")


def project_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.projects(archive(spark, sf_dir).need("events")).select("name", F.array_join("paths", ",").alias("paths"), F.array_join("branches", ",").alias("branches"), "event_count")


def artifact_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts of long texts: digest, size and how many events refer to them."""
    a = archive(spark, sf_dir)
    return ledger.artifacts(a.need("events"), a.need("artifacts")).select("sha256", "size", "copied", "mime", F.size("event_ids").cast("long").alias("events"))


def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored files, read back: what was cut from events is all there."""
    a = archive(spark, sf_dir)
    whole = ingest.with_whole_texts(a.need("events"), f"{ingest.local(a.folder)}/artifacts").where("variant_of is null")
    return whole.select(_conv().alias("conv_id"), _turn().alias("turn"), F.sha2(F.get("content", F.lit(0))["text"], 256).alias("text_sha256"))


def machine_of_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's machine goes before its source's: here every copy gets the machine of the first."""
    a = archive(spark, sf_dir)
    e = a.need("events")
    return ledger.machine_of(e, a.conversations()).groupBy(F.coalesce("machine_id", F.lit("-")).alias("machine")).agg(F.count(F.lit(1)).alias("events"))


def conversation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    pairs = ledger.rebuild_conversation_sources(a.need("events"), a.need("observations"))
    names = a.need("events").select("conversation_id", _conv().alias("conv_id")).distinct()
    return pairs.join(names, "conversation_id").groupBy("conv_id").agg(F.countDistinct("source_id").alias("sources"))


def inventory_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with what became of it."""
    rows = dataset.inventory_rows(archive(spark, sf_dir).need("inventory"))
    return rows.select(_conv("path").alias("conv_id"), F.regexp_extract("path", r"([a-z.]+)$", 1).alias("file"), _kind("path").alias("copy"), "problem", "parser", "status")


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a resumed import would read: nothing of what is complete, and all of what has changed since."""
    a = archive(spark, sf_dir)
    listed = a.need("inventory").where("import_run = 'r2' and problem is null").select("path", "fingerprint")
    changed = listed.withColumn("fingerprint", F.when(_conv("path") % 2 == 0, F.lit("changed")).otherwise(F.col("fingerprint")))
    return a.pending(changed).select(_conv("path").alias("conv_id"), F.regexp_extract("path", r"([a-z.]+)$", 1).alias("file"), _kind("path").alias("copy"))


def completed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published runs, and whether anything was left aside."""
    a = archive(spark, sf_dir)
    return spark.createDataFrame([(r, len(a.files.names(".staging"))) for r in a.runs()], "import_run string, staged long")


def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).stats()


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset manifest's counts."""
    return dataset.manifest_stats(archive(spark, sf_dir))


def dataset_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each stream of the dataset, read back from its shards."""
    a = archive(spark, sf_dir)
    root = f"{ingest.local(a.folder)}/dataset"
    out = None
    for rel in ("data/events", "reports/inventory", *(f"data/aggregates/{n}" for n in dataset.STREAMS)):
        one = spark.read.text(f"file://{root}/{rel}").agg(F.lit(rel).alias("stream"), F.count(F.lit(1)).alias("records"))
        out = one if out is None else out.unionByName(one)
    return out


def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks of the sound archive and its dataset."""
    a = archive(spark, sf_dir)
    return validate.validate(a.need("events"), a.need("observations"), a.sources(), a.conversations()).unionByName(dataset.validate(a)).select("check", "passed", "failures")


def validate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of an archive that was damaged: events twice, observations, conversations and bases lost, an account that doesn't add up."""
    a = archive(spark, sf_dir)
    e, o, s = a.need("events"), a.need("observations"), a.sources()
    e = e.withColumn("conv", _conv())
    twice = e.where("conv % 5 = 0 and variant_of is null").unionByName(e)
    held = o.join(e.where("conv % 4 = 1").select("event_id").distinct(), "event_id", "left_anti")
    conversation = a.conversations().join(e.where("conv % 6 = 2").select("conversation_id").distinct(), "conversation_id", "left_anti")
    accounts = s.withColumn("examined", F.when(_conv("source_path") % 9 == 0, F.col("examined") + 1).otherwise(F.col("examined")))
    return validate.validate(twice, held, accounts, conversation).select("check", "passed", "failures")


def coverage_by_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and records by parser and outcome, from the drafts of all files."""
    a = archive(spark, sf_dir)
    files = ingest.local(f"{a.folder.rsplit('/', 1)[0]}/files")
    return validate.coverage(ingest.read(spark, [files], keep_secrets=True))


def multi_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that were seen more than once, with where."""
    a = archive(spark, sf_dir)
    seen = validate.multi_observed(a.need("observations"), a.sources())
    e = a.need("events").select("event_id", "native_id", "session_native")
    copies = F.array_join(F.transform(F.split("paths", ","), lambda p: F.regexp_extract(p, r"/files/([abc])/", 1)), "")
    return seen.join(e, "event_id").select(_conv().alias("conv_id"), _turn().alias("turn"), "n", copies.alias("copies"))


def provenance_of_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of the first event of conversation 3, which was seen in two files."""
    a = archive(spark, sf_dir)
    return a.provenance(_first_of(a, 3)).select(_kind().alias("copy"), "record_index", "examined")


def inspected_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = archive(spark, sf_dir)
    return a.inspect_event(_first_of(a, 3)).select(_conv().alias("conv_id"), "role", F.get("content", F.lit(0))["type"].alias("type"))


def _first_of(a: Archive, conv: int) -> str:
    return a.need("events").where((F.col("native_id") == f"u-{conv}-0") & F.col("variant_of").isNull()).first().event_id


def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each report's table."""
    rows = [(name, sum(line.startswith("| ") for line in lines) - 1) for name, lines in archive(spark, sf_dir).report_lines().items() if name in ("errors.md", "unresolved.md", "conflicts.md", "coverage.md", "sources.md", "conversations.md")]
    return spark.createDataFrame(rows, "report string, n long")


def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the event that its record names as its parent, found by native id inside the conversation."""
    e = archive(spark, sf_dir).need("events").withColumn("parent_event_id", F.lit(None).cast("string")).withColumn("shard_ord", F.struct("import_run", "source_id", "place"))
    with_p = export.with_parents(e.where("variant_of is null"))
    names = e.select(F.col("event_id").alias("parent_event_id"), F.col("native_id").alias("parent_native"))
    return with_p.join(names, "parent_event_id", "left").select(_conv().alias("conv_id"), _turn().alias("turn"), _turn("parent_native").alias("parent_turn"))


def archive_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full export's records: anchors, blocks, conversation, references and times."""
    r = archive(spark, sf_dir).records()
    block = lambda path: F.get_json_object("content", f"$[0].{path}")
    return r.select(
        _conv("working_directory").alias("no"), F.regexp_extract(F.col("source_refs")[0]["source_path"], r"conv-(\d+)", 1).cast("long").alias("conv_id"), "seq", "timestamp", "timestamp_confidence", "role", "model",
        F.col("conversation.event_count").alias("event_count"), F.col("conversation.first_event").alias("first_event"), F.col("conversation.started_at").alias("started_at"), F.size("source_refs").cast("long").alias("refs"),
        block("type").alias("block"), F.octet_length(block("text")).cast("long").alias("block_bytes"), block("truncation.full_bytes").cast("long").alias("full_bytes"), F.col("parent_event_id").isNotNull().alias("has_parent"),
    ).drop("no")


def harness_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compact export's lines: conversations first, then events; optional keys only where there is a value."""
    lines = archive(spark, sf_dir).harness_lines()
    get = lambda p: F.get_json_object("line", f"$.{p}")
    has = lambda k: F.contains("line", F.lit(f'"{k}":'))
    return lines.select(get("schema").alias("schema"), get("seq").cast("long").alias("seq"), get("role").alias("role"), get("event_type").alias("event_type"), has("machine_id").alias("placed"), get("hidden").alias("hidden"), has("subagent").alias("side"), has("source_refs").alias("refs"), get("timestamp_confidence").alias("confidence")).groupBy("schema", "seq", "role", "event_type", "placed", "hidden", "side", "refs", "confidence").agg(F.count(F.lit(1)).alias("n"))


def harness_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (source, record) of each event."""
    a = archive(spark, sf_dir)
    return export_records.harness_refs(a.need("observations")).groupBy(F.size("source_refs").cast("long").alias("refs")).agg(F.count(F.lit(1)).alias("events"))


def export_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark, sf_dir).export_stats().withColumnRenamed("sequence_only", "in_sequence")


def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conjunctions over the stored index of the archive: folded, over whole texts."""
    a = archive(spark, sf_dir)
    e = a.need("events").select(F.col("event_id").alias("id"), "native_id", "session_native", F.col("variant_of").isNotNull().alias("variant"))
    return a.index().match(WORDS).join(e, "id").select(_conv().alias("conv_id"), _turn().alias("turn"), "variant")


def search_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best matches with what stands around the first hit."""
    return archive(spark, sf_dir).search(WORDS, limit=10).select(F.round("rank", 6).alias("rank"), (F.size(F.split("preview", " ")) <= 16).alias("short"), F.contains("preview", F.lit("\n")).alias("broken"))


QUERIES = {
    f.__name__: f
    for f in (
        archive_events, archive_observations, archive_conflicts, archive_accounts, source_view, conversation_view, session_view, machine_view, project_view, artifact_view, artifact_bytes, machine_of_conversation, conversation_sources,
        inventory_view, resume_pending, completed_runs, archive_stats, manifest_counts, dataset_streams, dataset_checks, validate_findings, coverage_by_parser, multi_observed, provenance_of_event, inspected_event, report_tables,
        parent_resolution, archive_export, harness_records, harness_refs, export_statistics, archive_search, search_previews,
    )
}

_T = f"""
  WITH t AS (SELECT conv_id, turn, {_ROLE} AS role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
      CASE WHEN turn % 2 = 0 THEN ({START} + conv_id * 1000 + turn) * 1000000000 END AS ts_ns FROM conversations),
  e AS (SELECT *, false AS variant FROM t UNION ALL SELECT conv_id, turn, role, 'edited ' || conv_id, seq, ts_ns, true FROM t WHERE conv_id % 7 = 0 AND turn = 0),
  o AS (SELECT conv_id, turn, seq, 'a' AS copy, variant FROM e WHERE NOT variant UNION ALL SELECT conv_id, turn, seq, 'b', false FROM t WHERE conv_id % 3 = 0
      UNION ALL SELECT conv_id, turn, seq, 'c', turn = 0 FROM t WHERE conv_id % 7 = 0),
  f AS (SELECT conv_id, copy, 's.jsonl' AS file, count(*) AS records FROM o GROUP BY ALL),
  acc AS (SELECT conv_id, copy, file, records + CASE WHEN copy = 'a' AND conv_id % 4 = 0 THEN 1 ELSE 0 END AS examined,
      CASE copy WHEN 'a' THEN records WHEN 'c' THEN 1 ELSE 0 END AS imported, CASE copy WHEN 'a' THEN 0 WHEN 'c' THEN records - 1 ELSE records END AS duplicate, 0 AS skipped,
      CASE WHEN copy = 'a' AND conv_id % 4 = 0 THEN 1 ELSE 0 END AS failed FROM f
    UNION ALL SELECT DISTINCT conv_id, 'a', 'notes.txt', 1, 0, 0, 1, 0 FROM t WHERE conv_id % 10 = 0),
  runs AS (SELECT *, 'r1' AS import_run FROM acc UNION ALL SELECT * REPLACE (0 AS imported, imported + duplicate AS duplicate), 'r2' FROM acc),
  machine AS (SELECT *, CASE WHEN variant THEN NULL ELSE 'desk' END AS machine_id FROM e)
"""
_FIRST = f"({START} + conv_id * 1000) * 1000000000"
_PROJECT = "CASE WHEN conv_id % 5 = 0 THEN 'zero' ELSE 'p' || conv_id % 5 END"
SQL = {
    "archive_events": _T
    + f"""SELECT conv_id, turn, seq, role, 'message' AS event_type, variant, machine_id, {_PROJECT} AS project_name, 'b' || conv_id % 2 AS branch, CASE WHEN role = 'assistant' THEN 'm1' END AS model, 'r1' AS import_run,
        CASE WHEN strlen(text) <= {LIMIT} THEN strlen(text) ELSE (SELECT max(b) FROM (SELECT unnest([0, 1, 2, 3]) AS back, {LIMIT} - back AS b) WHERE substr(hex(encode(text)), 2 * b + 1, 1) NOT IN ('8', '9', 'A', 'B')) END::BIGINT AS inline_bytes,
        CASE WHEN strlen(text) > {LIMIT} THEN strlen(text) END AS full_bytes, CASE WHEN strlen(text) > {LIMIT} THEN sha256(text) END AS full_sha256 FROM machine""",
    "archive_observations": _T + "SELECT conv_id, turn, variant, copy, seq + 1 AS record_index, 'claude_code' AS parser, 'r1' AS import_run FROM o",
    "archive_conflicts": _T + "SELECT conv_id, turn, true AS has_variant FROM e WHERE variant",
    "archive_accounts": _T + "SELECT conv_id, file, copy, import_run, examined, imported, duplicate, skipped, failed, true AS balanced FROM runs",
    "source_view": _T
    + """SELECT conv_id, file, copy, CASE WHEN file = 's.jsonl' THEN 'claude_code' END AS parser, CASE WHEN max(failed) > 0 THEN 'failed' ELSE 'ok' END AS status, sum(examined)::BIGINT AS examined, sum(imported)::BIGINT AS imported,
        sum(duplicate)::BIGINT AS duplicate, sum(skipped)::BIGINT AS skipped, sum(failed)::BIGINT AS failed FROM runs GROUP BY ALL""",
    "conversation_view": _T
    + """SELECT conv_id, max(CASE WHEN role = 'assistant' THEN 'm1' END) AS model, '/work/p' || conv_id % 5 AS working_directory, 'desk' AS machine, arg_min(ts_ns, seq) FILTER (ts_ns IS NOT NULL) AS started_ns,
        arg_max(ts_ns, seq) FILTER (ts_ns IS NOT NULL) AS ended_ns, count(*) AS event_count FROM e GROUP BY conv_id""",
    "session_view": _T + "SELECT conv_id, min(ts_ns) AS started_ns, max(ts_ns) AS ended_ns, count(*) AS event_count FROM e GROUP BY conv_id",
    "machine_view": _T + "SELECT 'desk' AS machine_id, 1 AS evidence, count(*) AS event_count FROM t",
    "project_view": _T + f"SELECT {_PROJECT} AS name, string_agg(DISTINCT '/work/p' || conv_id % 5, ',') AS paths, string_agg(DISTINCT 'b' || conv_id % 2, ',' ORDER BY 'b' || conv_id % 2) AS branches, count(*) AS event_count FROM e GROUP BY 1",
    "artifact_view": _T + f"SELECT sha256(text) AS sha256, max(strlen(text)) AS size, true AS copied, 'text/plain' AS mime, count(*) AS events FROM e WHERE strlen(text) > {LIMIT} GROUP BY 1",
    "artifact_bytes": _T + "SELECT conv_id, turn, sha256(text) AS text_sha256 FROM t",
    "machine_of_conversation": _T + "SELECT 'desk' AS machine, count(*) AS events FROM e",
    "conversation_sources": _T + "SELECT conv_id, count(DISTINCT copy) AS sources FROM o GROUP BY conv_id",
    "inventory_view": _T
    + """SELECT conv_id, file, copy, NULL::VARCHAR AS problem, CASE WHEN file = 's.jsonl' THEN 'claude_code' END AS parser, CASE WHEN file = 'notes.txt' THEN 'unresolved' WHEN failed > 0 THEN 'partial' ELSE 'imported' END AS status FROM acc
        UNION ALL SELECT DISTINCT conv_id, 'nothing.jsonl', 'a', 'empty', NULL, 'skipped' FROM t WHERE conv_id % 10 = 0""",
    "resume_pending": _T + "SELECT conv_id, file, copy FROM acc WHERE conv_id % 2 = 0",
    "completed_runs": "SELECT unnest(['r1', 'r2']) AS import_run, 0 AS staged",
    "archive_stats": _T
    + """SELECT count(*) AS events, count(DISTINCT conv_id) AS conversations, 0 AS tool_calls, 0 AS tool_records, 0 AS redacted_events, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, (SELECT count(*) FROM o) AS observations,
        count(*) FILTER (variant) AS conflicts, (SELECT sum(failed)::BIGINT FROM runs) AS parse_errors FROM e""",
    "manifest_counts": _T
    + f"""SELECT count(*) AS events, count(DISTINCT conv_id) AS conversations, count(DISTINCT conv_id) AS sessions, count(DISTINCT {_PROJECT}) AS projects, 1 AS machines, 0 AS tool_calls, 0 AS redacted_events,
        (SELECT count(*) FROM acc) AS sources, count(DISTINCT CASE WHEN strlen(text) > {LIMIT} THEN text END) AS artifacts, count(*) FILTER (variant) AS conflicts FROM e""",
    "dataset_streams": _T
    + f"""SELECT 'data/events' AS stream, count(*) AS records FROM e UNION ALL SELECT 'reports/inventory', count(*) + (SELECT count(DISTINCT conv_id) FROM t WHERE conv_id % 10 = 0) FROM acc
        UNION ALL SELECT 'data/aggregates/conversations', count(DISTINCT conv_id) FROM t UNION ALL SELECT 'data/aggregates/sessions', count(DISTINCT conv_id) FROM t UNION ALL SELECT 'data/aggregates/projects', count(DISTINCT {_PROJECT}) FROM t
        UNION ALL SELECT 'data/aggregates/machines', 1 UNION ALL SELECT 'data/aggregates/artifacts', count(DISTINCT text) FROM e WHERE strlen(text) > {LIMIT}""",
    "dataset_checks": """SELECT unnest(['event_ids', 'provenance', 'observation_source', 'event_conversation', 'variant_base', 'accounting', 'manifest', 'layout', 'checksums', 'manifest_shards']) AS "check", true AS passed, 0 AS failures""",
    "validate_findings": _T
    + """, found AS (SELECT 'event_ids' AS "check", count(*) AS failures FROM t WHERE conv_id % 5 = 0
      UNION ALL SELECT 'provenance', (SELECT count(*) FROM e WHERE conv_id % 4 = 1) + (SELECT count(*) FROM t WHERE conv_id % 4 = 1 AND conv_id % 5 = 0) UNION ALL SELECT 'observation_source', 0
      UNION ALL SELECT 'event_conversation', (SELECT count(*) FROM e WHERE conv_id % 6 = 2) + (SELECT count(*) FROM t WHERE conv_id % 6 = 2 AND conv_id % 5 = 0) UNION ALL SELECT 'variant_base', 0
      UNION ALL SELECT 'accounting', count(*) FROM acc WHERE conv_id % 9 = 0) SELECT "check", failures = 0 AS passed, failures FROM found""",
    "coverage_by_parser": _T
    + """SELECT CASE WHEN file = 's.jsonl' THEN 'claude_code' ELSE '' END AS parser, count(*) AS files, (sum(examined) - sum(failed) - sum(skipped))::BIGINT AS events, sum(skipped)::BIGINT AS skipped, sum(failed)::BIGINT AS failed FROM acc GROUP BY 1
        ORDER BY files DESC, parser""",
    "multi_observed": _T
    + """, e2 AS (SELECT conv_id, turn, variant, count(*) AS n, string_agg(copy, '' ORDER BY copy) AS copies FROM o GROUP BY ALL HAVING count(*) > 1) SELECT conv_id, turn, n, copies FROM e2""",
    "provenance_of_event": _T + "SELECT copy, seq + 1 AS record_index, (2 * acc.examined)::BIGINT AS examined FROM o JOIN acc USING (conv_id, copy) WHERE conv_id = 3 AND turn = 0 AND file = 's.jsonl'",
    "inspected_event": _T + "SELECT conv_id, role, 'text' AS type FROM t WHERE conv_id = 3 AND turn = 0",
    "report_tables": _T
    + """SELECT 'errors.md' AS report, (SELECT sum(failed)::BIGINT FROM runs) AS n UNION ALL SELECT 'unresolved.md', count(*) FROM runs WHERE file = 'notes.txt' UNION ALL SELECT 'conflicts.md', count(*) FROM e WHERE variant
        UNION ALL SELECT 'coverage.md', 1 UNION ALL SELECT 'sources.md', least(500, count(*)) FROM acc UNION ALL SELECT 'conversations.md', least(500, count(DISTINCT conv_id)) FROM t""",
    "parent_resolution": _T + "SELECT a.conv_id, a.turn, b.turn AS parent_turn FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1",
    "archive_export": _T
    + f"""SELECT conv_id, seq, CASE WHEN ts_ns IS NOT NULL THEN strftime(make_timestamp_ns(ts_ns), '%Y-%m-%dT%H:%M:%S') || '.000000000Z' END AS timestamp, CASE WHEN ts_ns IS NULL THEN 'unknown' ELSE 'exact' END AS timestamp_confidence, role,
        CASE WHEN role = 'assistant' THEN 'm1' END AS model, count(*) OVER (PARTITION BY conv_id) AS event_count, seq = 0 AS first_event, strftime(make_timestamp_ns({_FIRST}), '%Y-%m-%dT%H:%M:%SZ') AS started_at,
        (SELECT count(*) FROM o WHERE o.conv_id = e.conv_id AND o.turn = e.turn AND o.variant = e.variant) AS refs, 'text' AS block,
        CASE WHEN strlen(text) <= {LIMIT} THEN strlen(text) ELSE (SELECT max(b) FROM (SELECT unnest([0, 1, 2, 3]) AS back, {LIMIT} - back AS b) WHERE substr(hex(encode(text)), 2 * b + 1, 1) NOT IN ('8', '9', 'A', 'B')) END::BIGINT AS block_bytes,
        CASE WHEN strlen(text) > {LIMIT} THEN strlen(text) END AS full_bytes, turn > 0 AS has_parent FROM e""",
    "harness_records": _T
    + """SELECT 'talewright.harness/v1' AS schema, seq, role, 'message' AS event_type, true AS placed, 'false' AS hidden, false AS side, true AS refs, CASE WHEN ts_ns IS NULL THEN 'unknown' ELSE 'exact' END AS confidence, count(*) AS n FROM e GROUP BY ALL
        UNION ALL SELECT 'talewright.harness.conversation/v1', NULL, NULL, NULL, false, NULL, false, false, NULL, count(DISTINCT conv_id) FROM t""",
    "harness_refs": _T + ", n AS (SELECT count(*) AS refs FROM o GROUP BY conv_id, turn, variant) SELECT refs, count(*) AS events FROM n GROUP BY refs",
    "export_statistics": _T + "SELECT count(*) AS events, count(*) FILTER (ts_ns IS NULL) AS null_timestamps, 0 AS derived, count(*) FILTER (ts_ns IS NOT NULL) AS exact, count(*) FILTER (ts_ns IS NULL) AS unknown, 0 AS in_sequence, 0 AS duplicates FROM e",
    "archive_search": _T + r"""SELECT conv_id, turn, variant FROM e WHERE list_contains(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+'), 'de') AND list_contains(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+'), 'la')""",
    "search_previews": _T
    + r""", tokens AS (SELECT conv_id, turn, variant, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+') AS w FROM e), n AS (SELECT count(*) AS n, avg(len(w)) AS av FROM tokens WHERE len(w) > 0),
      both_ AS (SELECT *, unnest(['de', 'la']) AS term FROM tokens), tf AS (SELECT *, len(list_filter(w, lambda x: x = term)) AS tf FROM both_), df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
      scored AS (SELECT conv_id, turn, variant, -sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / av))) AS rank, min(tf) AS least FROM tf JOIN df USING (term), n GROUP BY ALL)
      SELECT round(rank, 6) AS rank, true AS short, false AS broken FROM scored WHERE least > 0 ORDER BY rank LIMIT 10""",
}
