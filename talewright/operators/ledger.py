"""Views over append-only facts that stand for the ledger's mutable rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import platform_hint

def first_known(col: str, order: str) -> Column:
    """The first value, in order, that isn't null."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def last_known(col: str, order: str) -> Column:
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def sources(runs: DataFrame, *, order: str = "run_ord", counters: tuple[str, ...] = ("examined", "imported", "duplicate", "skipped", "failed")) -> DataFrame:
    """source_id's facts of all runs folded: guesses by the first known, status by the last run, counters added, notes joined by line."""
    guesses = [c for c in ("provider_guess", "application_guess", "parser", "parser_version", "confidence") if c in runs.columns]
    notes = [F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.coalesce("notes", F.lit("")) != "", F.struct(F.col(order).alias("o"), F.col("notes").alias("n"))))), lambda x: x["n"]), "\n").alias("notes")] if "notes" in runs.columns else []
    return runs.groupBy("source_id").agg(
        *[first_known(c, order).alias(c) for c in guesses],
        F.max_by("status", order).alias("status"),
        F.min(order).alias("first_run"),
        F.max(order).alias("last_run"),
        *[F.sum(c).alias(c) for c in counters],
        *notes,
    )


def conversations(events: DataFrame, *, order: str = "seq") -> DataFrame:
    """conversation_id with the first known title, model, agent, machine, project, repository and directory, the first and last event's time (in order, not by size) and the number of events."""
    known = [c for c in "agent model title working_directory repository_id project_id machine_id".split() if c in events.columns]
    return events.groupBy("conversation_id").agg(
        *[first_known(c, order).alias(c) for c in known],
        first_known("ts_ns", order).alias("started_ns"),
        last_known("ts_ns", order).alias("ended_ns"),
        F.countDistinct("event_id").alias("event_count"),
    )


def projects(events: DataFrame, *, order: str = "seq") -> DataFrame:
    """project_id with its repository, last name, paths, branches and number of events."""
    return events.where("project_id is not null").groupBy("project_id").agg(
        first_known("repository_id", order).alias("repository_id"),
        last_known("project_name", order).alias("name"),
        F.sort_array(F.collect_set("working_directory")).alias("paths"),
        F.sort_array(F.collect_set("branch")).alias("branches"),
        F.count(F.lit(1)).alias("event_count"),
    )


def rebuild_conversation_sources(events: DataFrame, observation: DataFrame) -> DataFrame:
    """Distinct (conversation_id, source_id) over all observations."""
    return events.select("event_id", "conversation_id").join(observation.select("event_id", "source_id"), "event_id").select("conversation_id", "source_id").distinct()


def unfinished(listing: DataFrame, state: DataFrame, keys: tuple[str, ...] = ("state_key", "fingerprint", "parser", "version")) -> DataFrame:
    """Rows of a listing whose keys (of state_key, fingerprint, parser and version) aren't those of its last state, or that isn't complete."""
    last = state.groupBy("state_key").agg(F.max_by(F.struct("fingerprint", "parser", "version", "complete"), "run_ord").alias("s"))
    done = last.where("s.complete").select("state_key", "s.fingerprint", "s.parser", "s.version")
    return listing.join(done.select(*keys), list(keys), "left_anti")


def sessions(events: DataFrame, *, order: str = "seq") -> DataFrame:
    """session_id with its conversation, span of times and number of events; what was said first counts."""
    return events.where("session_id is not null").groupBy("session_id").agg(
        first_known("session_native", order).alias("native_id"),
        first_known("conversation_id", order).alias("conversation_id"),
        F.min("ts_ns").alias("started_ns"),
        F.max("ts_ns").alias("ended_ns"),
        F.countDistinct("event_id").alias("event_count"),
    )


def machines(events: DataFrame, *, order: str = "seq") -> DataFrame:
    """machine_id with its platform (first known, by the paths seen on it), number of events and paths' drives or roots."""
    seen = events.where("machine_id is not null").withColumn("platform", F.nullif(platform_hint(F.col("source_path")), F.lit("unknown")))
    return seen.groupBy("machine_id").agg(
        first_known("platform", order).alias("platform"),
        F.sort_array(F.collect_set(F.regexp_extract("source_path", r"^(/[^/]*|[A-Za-z]:)", 1))).alias("evidence"),
        F.countDistinct("event_id").alias("event_count"),
    )


def artifacts(events: DataFrame, stored: DataFrame) -> DataFrame:
    """artifact_id with its digest, size, whether its bytes are there, and the events that refer to it."""
    long = F.filter("content", lambda p: p["truncation"].isNotNull())
    links = events.select("event_id", F.explode(F.transform(long, lambda p: p["truncation"]["full_sha256"])).alias("sha256")).distinct()
    by = links.groupBy("sha256").agg(F.sort_array(F.collect_list("event_id")).alias("event_ids"))
    once = stored.groupBy("artifact_id", "sha256").agg(F.max("size").alias("size"), F.max("copied").alias("copied"), F.min("mime").alias("mime"), F.min("source_path").alias("source_path"))
    return once.join(by, "sha256", "left")


def machine_of(events: DataFrame, conversation: DataFrame) -> DataFrame:
    """events with machine_id: that of their conversation, if it has one already, before their source's."""
    known = conversation.select("conversation_id", F.col("machine_id").alias("__m")).where("__m is not null")
    return events.join(known, "conversation_id", "left").withColumn("machine_id", F.coalesce("__m", "machine_id")).drop("__m")
