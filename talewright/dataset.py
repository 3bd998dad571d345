"""The dataset that an archive publishes: event shards, five aggregate streams, inventory, manifest and checksums."""

from __future__ import annotations

import datetime as dt
import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.times import to_rfc3339
from .operators import ledger
from .sinks import files
from .sources.ingest import local

if TYPE_CHECKING:
    from .archive import Archive

FORMAT, FORMAT_VERSION, SCHEMA_VERSION = "talewright.dataset", 1, 1
STREAMS = ("conversations", "sessions", "projects", "machines", "artifacts")
REASONS = 20


def inventory(listed: DataFrame, seen: DataFrame) -> DataFrame:
    """A row for each listed file that has a problem or was read: what became of it.

    seen(path, parser, version, failed, examined, imported); files that were neither read nor have a problem are left out, as
    what an earlier run says of them still holds.
    """
    out = listed.join(seen, "path", "left").where("problem is not null or examined is not null")
    status = F.when(F.col("problem").isNotNull(), "skipped").when(F.col("parser").isNull(), "unresolved").when(F.col("failed") > 0, "partial").otherwise("imported")
    return out.withColumn("status", status).withColumn("complete", F.col("examined").isNotNull())


def inventory_rows(rows: DataFrame) -> DataFrame:
    """The last row of each file over all runs, by path and source."""
    last = rows.groupBy("path", "source_id").agg(F.max_by(F.struct("size", "problem", "parser", "version", "status", "examined", "imported", "failed"), "import_run").alias("r"))
    return last.select("path", "source_id", "r.*").orderBy("path", "source_id")


def aggregates(events: DataFrame, observation: DataFrame, stored: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """The five streams by name; sets hang on them by one grouped join each."""
    e = events.withColumn("session_id", F.col("session_native")) if "session_id" not in events.columns else events
    of = ledger.rebuild_conversation_sources(events, observation).groupBy("conversation_id").agg(F.sort_array(F.collect_set("source_id")).alias("source_ids"))
    times = lambda df: df.withColumn("started_at", to_rfc3339(F.col("started_ns"))).withColumn("ended_at", to_rfc3339(F.col("ended_ns"))).drop("started_ns", "ended_ns")
    return {
        "conversations": times(ledger.conversations(events).join(of, "conversation_id", "left")),
        "sessions": times(ledger.sessions(e)),
        "projects": ledger.projects(events),
        "machines": ledger.machines(events),
        "artifacts": ledger.artifacts(events, stored),
    }


def counts(archive: Archive) -> dict:
    """What the manifest says of the whole archive."""
    e = archive.need("events").agg(
        F.count(F.lit(1)).alias("events"),
        F.countDistinct("conversation_id").alias("conversations"),
        F.countDistinct("session_native").alias("sessions"),
        F.countDistinct("project_id").alias("projects"),
        F.countDistinct("machine_id").alias("machines"),
        F.count_if(F.col("event_type").isin("tool_call", "tool_result")).alias("tool_calls"),
        F.count_if(F.size("redactions") > 0).alias("redacted_events"),
        to_rfc3339(F.min("ts_ns")).alias("first"),
        to_rfc3339(F.max("ts_ns")).alias("last"),
    ).first().asDict()
    first, last = e.pop("first"), e.pop("last")
    e["sources"] = archive.need("sources").select("source_id").distinct().count()
    e["artifacts"] = archive.need("artifacts").select("sha256").distinct().count()
    e["conflicts"] = archive.need("conflicts").count()
    return e | {"date_range": [first, last] if first else None}


def write(archive: Archive) -> dict:
    """Write the dataset below <archive>/dataset and give its manifest, which is written last but for the checksums."""
    folder, root = archive.files, f"{local(archive.folder)}/dataset"
    folder.drop("dataset")
    shard = lambda df, rel: [r.asDict() | {"path": r.path[len(root) + 1 :]} for r in files.write_shards(df, f"{root}/{rel}").collect()]
    shards = sorted(shard(archive.need("events").sort("source_id", "place"), "data/events"), key=lambda s: s["path"])
    for name, df in archive.aggregates().items():
        shard(df, f"data/aggregates/{name}")
    shard(inventory_rows(archive.need("inventory")), "reports/inventory")
    runs = [json.loads(folder.read(f"_runs/{r}")) for r in archive.runs()]
    manifest = {"format": FORMAT, "format_version": FORMAT_VERSION, "schema_version": SCHEMA_VERSION, "updated_at": dt.datetime.now(dt.timezone.utc).isoformat(), "redaction_policy": archive.config.secrets.policy, "counts": counts(archive), "event_shards": shards, "import_runs": runs}
    folder.write("dataset/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    lines = (f"{r.sha256}  {r.path}" for r in files.checksums(archive.spark, root).toLocalIterator())
    folder.write("dataset/SHA256SUMS", "\n".join(lines) + "\n")
    return manifest


def manifest_of(archive: Archive) -> dict:
    return json.loads(archive.files.read("dataset/manifest.json"))


def manifest_stats(archive: Archive) -> DataFrame:
    """The manifest's counts as one row."""
    c = manifest_of(archive)["counts"]
    return archive.spark.createDataFrame([tuple(v for k, v in sorted(c.items()) if k != "date_range")], ", ".join(f"{k} long" for k in sorted(c) if k != "date_range"))


def validate(archive: Archive) -> DataFrame:
    """(check, passed, failures, reasons) of the manifest, layout, checksums and shards."""
    spark, root = archive.spark, f"{local(archive.folder)}/dataset"
    bad: dict[str, list[str]] = {"manifest": [], "layout": []}
    manifest = manifest_of(archive)
    for key, want in (("format", FORMAT), ("format_version", FORMAT_VERSION), ("schema_version", SCHEMA_VERSION)):
        if manifest.get(key) != want:
            bad["manifest"].append(f"{key} is {manifest.get(key)!r}, not {want!r}")
    for rel in ("dataset/data/events", "dataset/SHA256SUMS", "observations", "sources"):
        if not archive.files.exists(rel):
            bad["layout"].append(f"{rel} is missing")
    rows = [(name, not reasons, len(reasons), reasons) for name, reasons in bad.items()]
    out = spark.createDataFrame(rows, "check string, passed boolean, failures long, reasons array<string>")
    found = files.checksums(spark, root).withColumnRenamed("sha256", "is")
    listed = spark.read.text(f"file://{root}/SHA256SUMS").select(F.substring("value", 1, 64).alias("was"), F.substring("value", 67, 100_000).alias("path")).where("path != ''")
    sums = found.join(listed, "path", "full").where(~F.col("is").eqNullSafe(F.col("was")))
    why = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "not listed").otherwise("changed")
    out = out.unionByName(_checked("checksums", sums.select(F.concat_ws(": ", "path", why).alias("r"))))
    shards = spark.createDataFrame([(s["path"], s["records"], s["sha256"]) for s in manifest["event_shards"]], "path string, records long, was string")
    lost = shards.join(found, "path", "left").where(~F.col("is").eqNullSafe(F.col("was")))
    total = archive.need("events").agg(F.count(F.lit(1)).alias("n")).crossJoin(shards.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("records"))).where("n != records")
    return out.unionByName(_checked("manifest_shards", lost.select(F.col("path").alias("r")).unionByName(total.select(F.format_string("%d events, %d in shards", "n", "records").alias("r")))))


def _checked(name: str, bad: DataFrame) -> DataFrame:
    """A row of a check from its failures, of which the least REASONS are kept."""
    top = bad.orderBy("r").limit(REASONS).agg(F.array_sort(F.collect_list("r")).alias("reasons"))
    n = bad.agg(F.count(F.lit(1)).alias("failures"))
    return n.crossJoin(top).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures", "reasons")
