"""An archive as append-only tables in a folder, and what can be done with it."""

from __future__ import annotations

import datetime as dt
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dataset
from .config import Config
from .functions.ids import id_of, make_id, session_id
from .functions.parts import searchable
from .functions.redact import redacted
from .operators import classify, export, export_records, identity, ledger, report, search, validate
from .sinks import files
from .sources import ingest, registry, repository
from .storage import Folder

#: Facts of a run; see dataset for what is made of them.
TABLES = ("events", "observations", "conflicts", "outcomes", "sources", "inventory", "artifacts")


class Archive:
    """Facts of all runs: events, observations, conflicts, outcomes (skipped and failed records), sources, inventory and artifacts.

    A run's tables are written aside, renamed to <table>/run=<run> and then published by the file _runs/<run>: a run is
    there as a whole or not at all, and readers see published runs only. What a crash leaves is replaced when the run is repeated.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config | None = None):
        self.spark, self.folder, self.config = spark, folder, config or Config()
        self.files = Folder(spark, folder)

    def runs(self) -> list[str]:
        return [r for r in self.files.names("_runs") if not r.endswith(".part")]

    def table(self, name: str) -> DataFrame | None:
        there = set(self.files.names(name))
        paths = [self.files.at(f"{name}/run={r}") for r in self.runs() if f"run={r}" in there]
        return self.spark.read.parquet(*paths) if paths else None

    def need(self, name: str) -> DataFrame:
        df = self.table(name)
        if df is None:
            raise FileNotFoundError(f"{self.folder}: no {name}")
        return df

    def pending(self, listed: DataFrame) -> DataFrame:
        """Rows of a listing that no run has completed with the same fingerprint, parser and version."""
        done = self.table("inventory")
        if done is None:
            return listed
        state = done.select(F.col("path").alias("state_key"), "fingerprint", "parser", "version", "complete", F.col("import_run").alias("run_ord"))
        now = F.create_map(*[F.lit(x) for p in registry.PARSERS for x in (p.id, p.version)])
        current = state.where(F.col("parser").isNull() | (F.try_element_at(now, F.col("parser")) == F.col("version")))
        return ledger.unfinished(listed.withColumn("state_key", F.col("path")), current, keys=("state_key", "fingerprint")).drop("state_key")

    def import_(self, roots: list[str], *, run: str | None = None, only: str | None = None, keep_secrets: bool = False, resume: bool = False, dry_run: bool = False, repositories: bool = False) -> DataFrame:
        """Import files; gives the run's account by source. Importing again adds no event and no observation."""
        run = run or make_id("run_", dt.datetime.now(dt.timezone.utc).isoformat(), str(os.getpid()))[:16]
        listed = ingest.listing(self.spark, roots, self.config.limits)
        wanted = listed.where("problem is null")
        if resume:
            wanted = self.pending(wanted)
        drafts = ingest.read_listed(wanted, only=only, keep_secrets=keep_secrets or self.config.secrets.policy == "preserve")
        return self.take(drafts, listed=listed, run=run, dry_run=dry_run, repositories=repositories)

    def take(self, drafts: DataFrame, *, run: str, listed: DataFrame | None = None, dry_run: bool = False, repositories: bool = False) -> DataFrame:
        """Classify a run's drafts against the archive and publish every table made of them."""
        stage = f".staging/{run}"
        self.files.drop(stage)

        def aside(df: DataFrame, name: str) -> DataFrame:
            """Records are parsed, identified and classified once: every table of the run is made of what is kept here."""
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.files.at(f"{stage}/{name}"))
            return self.spark.read.schema(df.schema).parquet(self.files.at(f"{stage}/{name}"))

        drafts = aside(drafts, "drafts")
        most = self.config.limits.max_inline_text_bytes
        events = ingest.events(drafts, max_inline=most)
        order = F.struct("source_path", "chain", "place")
        arrivals = aside(events.withColumn("ord", order).withColumn("record_index", F.col("record")), "arrivals")
        archived = self.table("events")
        done = aside(classify.classify(arrivals, None if archived is None else archived.select("event_id", "content_fp")), "classified")
        source = ingest.source_name()
        other = drafts.where("outcome != 'event'").withColumn("source_id", id_of("src_", source))
        account = classify.accounting(done, failed=other.where("outcome = 'failed'"), skipped=other.where("outcome = 'skipped'"))
        own = ["source_id", "source_path", "chain", "file_path", "parser", "parser_version"]
        names = arrivals.select(*own).unionByName(other.select(*own)).groupBy("source_id").agg(*[(F.max if c.startswith("parser") else F.min)(c).alias(c) for c in own[1:]])
        account = aside(account.join(names, "source_id").withColumn("path", ingest.file_of()), "account")
        # files that hold the sources, with whether all of their records were read
        seen = account.groupBy("path").agg(F.max("parser").alias("parser"), F.max("parser_version").alias("version"), F.sum("failed").alias("failed"), *[F.sum(c).cast("long").alias(c) for c in ("examined", "imported")])
        if listed is None:
            listed = seen.select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("mtime_ns"), F.lit("").alias("fingerprint"), id_of("src_", F.col("path")).alias("source_id"), F.lit(None).cast("string").alias("problem"))
        inventory = dataset.inventory(listed, seen)
        account = account.join(listed.select("path", "fingerprint"), "path", "left").withColumn("import_run", F.lit(run))
        if dry_run:
            return account.drop("path")
        new = done.where(F.col("status").isin("new", "variant_new"))
        new = new.withColumn("session_id", session_id(F.col("provider"), F.col("application"), F.col("session_native")))
        new = self._placed(new, repositories).withColumn("event_id", F.col("stored_id")).drop("ord", "record_index", "base_fp", "stored_id", "status")
        observed = classify.observations(done, self.table("observations")).select("event_id", "source_id", "record_index", "parser", "identity_tier", "source_path")
        blobs = ingest.spilled(drafts, max_inline=most)
        stored = files.store_artifacts(blobs.select(F.encode("text", "UTF-8").alias("data")), f"{ingest.local(self.folder)}/artifacts", most=self.config.limits.max_artifact_bytes)
        artifacts = stored.join(blobs.groupBy("sha256").agg(F.min("source_path").alias("source_path")), "sha256", "left")
        written = {
            "events": new,
            "observations": observed,
            "conflicts": classify.conflicts(done, self.table("conflicts")),
            "outcomes": other.select("source_id", "source_path", "chain", "record", "outcome", "error"),
            "sources": account.drop("path"),
            "inventory": inventory,
            "artifacts": artifacts.select(id_of("art_", "sha256", F.col("sha256")).alias("artifact_id"), "*", F.lit("text/plain").alias("mime")),
        }
        for name, df in written.items():
            df.withColumn("import_run", F.lit(run)).write.option("compression", "zstd").parquet(self.files.at(f"{stage}/{name}"))
        for name in written:
            self.files.move(f"{stage}/{name}", f"{name}/run={run}")
        self.files.write(f"_runs/{run}", json.dumps({"run": run, "finished_at": dt.datetime.now(dt.timezone.utc).isoformat()}))
        self.files.drop(stage)
        self.files.drop("index")  # it is of the runs before
        return self.spark.read.parquet(self.files.at(f"sources/run={run}"))

    def _placed(self, events: DataFrame, repositories: bool) -> DataFrame:
        """events with machine, repository and project by configuration and directory."""
        out = events.withColumn("working_directory", F.col("cwd"))
        remotes = repository.remotes(out, path_col="working_directory") if repositories else None
        out = out.withColumn("remote", F.lit(None).cast("string")) if remotes is None else out.join(remotes, "working_directory", "left")
        out = identity.projects(out, self.config.project_rules(self.spark))
        return identity.by_prefix(out, self.config.machine_rules(self.spark), path_col="source_path", value_col="machine", into="machine_id").drop("remote")

    def export(self, *, harness: bool = False) -> DataFrame:
        e = self.need("events").withColumn("session_id", F.col("session_native")).withColumn("parent_event_id", F.lit(None).cast("string"))
        ordered = export.chronological(e.withColumn("shard_ord", F.struct("import_run", "source_id", "place")), harness=harness)
        return export.hidden(ordered.withColumn("text", searchable(F.col("content")))) if harness else ordered

    def records(self) -> DataFrame:
        """The full export's lines, in order."""
        refs = export_records.source_refs(self.need("observations"), self.sources())
        return export_records.records(self.export(), self.conversations(), refs)

    def harness_lines(self) -> DataFrame:
        """(part, line, order columns) of the compact export: conversation records first, then events in order."""
        refs = export_records.harness_refs(self.need("observations"))
        return export_records.harness_lines(self.export(harness=True), self.conversations(), refs)

    def export_stats(self) -> DataFrame:
        return export_records.export_stats(self.export(), self.need("events"))

    def report_lines(self) -> dict[str, Iterator[str]]:
        """File name to the lines of a report, which are made as they are read."""
        return report.pages(self.need("events"), self.need("observations"), self.need("conflicts"), self.need("outcomes"), self.sources())

    def reports(self) -> dict[str, str]:
        return {name: "".join(f"{line}\n" for line in lines) for name, lines in self.report_lines().items()}

    def texts(self) -> DataFrame:
        """(event_id, text): what a search looks through, scrubbed again; the whole of a text that was spilled."""
        e = self.need("events").dropDuplicates(["event_id"])
        whole = ingest.with_whole_texts(e, f"{ingest.local(self.folder)}/artifacts")
        return whole.select("event_id", redacted(searchable(F.col("content"))).alias("text"))

    def rebuild_index(self) -> int:
        """Write the postings anew; gives the number of texts."""
        run = make_id("ix_", dt.datetime.now(dt.timezone.utc).isoformat())
        n = search.write_index(self.texts(), self.files.at(f".staging/{run}"))
        self.files.move(f".staging/{run}", "index/search")
        return n

    def index(self) -> search.Index:
        """The stored postings; made where there are none."""
        if not self.files.exists("index/search"):
            self.rebuild_index()
        return search.Index(self.spark, self.files.at("index/search"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """(id, rank, preview) of the best matches."""
        best = self.index().bm25(query, limit=limit)
        return search.with_previews(best, self.texts().withColumnRenamed("event_id", "id"), query)

    def conversations(self) -> DataFrame:
        return ledger.conversations(self.need("events"))

    def sources(self) -> DataFrame:
        s = self.need("sources").withColumn("status", F.when(F.col("failed") > 0, "failed").otherwise("ok"))
        return ledger.sources(s, order="import_run").join(s.groupBy("source_id").agg(F.min("source_path").alias("source_path")), "source_id")

    def aggregates(self) -> dict[str, DataFrame]:
        return dataset.aggregates(self.need("events"), self.need("observations"), self.need("artifacts"), self.need("sources"))

    def write_dataset(self) -> dict:
        """Shards, the five aggregate streams, inventory, manifest and checksums beside the tables; gives the manifest."""
        return dataset.write(self)

    def validate(self) -> DataFrame:
        checks = validate.validate(self.need("events"), self.need("observations"), self.sources(), self.conversations())
        return checks.unionByName(dataset.validate(self)) if self.files.exists("dataset/manifest.json") else checks

    def stats(self) -> DataFrame:
        """One row of counters; from the manifest where there are no tables."""
        if self.table("events") is None:
            return dataset.manifest_stats(self)
        outcomes = self.need("outcomes").where("outcome = 'failed'")
        return validate.stats(self.need("events"), self.need("observations"), self.need("conflicts"), outcomes)

    def provenance(self, event_id: str) -> DataFrame:
        """Where an event was seen; an error if it never was."""
        seen = self.need("observations").where(F.col("event_id") == event_id)
        if seen.isEmpty():
            raise LookupError(f"{event_id}: no such event")
        return seen.drop("source_path").join(self.sources(), "source_id", "left").orderBy("source_id", "record_index")

    def inspect_event(self, event_id: str) -> DataFrame:
        """The event's record; an error if there is none."""
        found = self.need("events").where(F.col("event_id") == event_id).limit(1)
        if found.isEmpty():
            raise LookupError(f"{event_id}: no such event")
        return found
