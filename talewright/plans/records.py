"""Classification, accounting, aggregates and lookups over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths, redact
from ..lineage import cut, kept
from ..operators import classify as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha_variant(event_id: Column, content_fp: Column) -> Column:
    """A variant id that DuckDB can make as well."""
    return F.concat(F.lit("v_"), F.substring(F.sha2(F.concat_ws("|", event_id, content_fp), 256), 1, 24))


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as arrivals: the event is the first 40 signs, the source the source, the order the doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.sha2(F.lower(F.substring("text", 1, 40)), 256).alias("event_id"),
        F.sha2("text", 256).alias("content_fp"),
        F.col("source").alias("source_id"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 5).cast("long").alias("record_index"),
        F.col("lang").alias("parser"),
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.classify(arrivals(spark, sf_dir), variant=sha_variant)


def classify_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("ord", "stored_id", "status", "variant_of")


def conflict_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflicts(classified(spark, sf_dir))


def observation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.observations(classified(spark, sf_dir)).select(*C.OBSERVATION_KEY)


def accounting_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi").select(F.col("source").alias("source_id"))
    return C.accounting(classified(spark, sf_dir), failed=failed)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit("\npassword=hunter2secret Authorization: Bearer abc.def-123\nsk-ant-api03-AbCdEfGhIjKlMnOpQr"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", planted.alias("text"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by kind over documents, with one of each planted behind every hundredth text."""
    hit = _planted(spark, sf_dir).select(F.explode(redact.hits(F.col("text"))).alias("h"))
    return hit.groupBy(F.col("h.kind").alias("kind")).agg(F.sum("h.count").alias("hits"), F.count(F.lit(1)).alias("texts"))


def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts redacted, by columns and by the import's own pass in Python."""

    @F.pandas_udf("string")
    def scrubbed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact.scrub(t)[0])

    return _planted(spark, sf_dir).select("doc_id", F.sha2(redact.redacted(F.col("text")), 256).alias("text_sha256"), F.sha2(scrubbed("text"), 256).alias("scrubbed_sha256"))


LIMIT = 4096


def truncate_spill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents imported with LIMIT bytes a text: what stays inline, and the bytes of the artifact that holds the whole."""
    from ..sinks.files import store_artifacts, stored_artifacts
    from ..sources import ingest

    docs = table(spark, sf_dir, "documents")
    line = F.to_json(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    files = docs.select(F.format_string("/d/%d.jsonl", "doc_id").alias("path"), F.encode(line, "UTF-8").alias("content"))
    drafts = cut(ingest.drafts(files, keep_secrets=True), "drafts")

    def build(folder: str) -> DataFrame:
        where = f"{ingest.local(folder)}/artifacts"
        store_artifacts(ingest.spilled(drafts, max_inline=LIMIT).select(F.encode("text", "UTF-8").alias("data")), where).agg(F.sum("size")).collect()
        return stored_artifacts(spark, where).select("name", F.col("sha256").alias("sha"), F.col("size").alias("stored_bytes"))

    blobs = kept(spark, ("spill", sf_dir), build)
    part = F.get("content", F.lit(0))
    about = part["truncation"]
    e = ingest.events(drafts, max_inline=LIMIT).select(F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("doc_id"), part["text"].alias("text"), about["full_sha256"].alias("full_sha256"), about["full_bytes"].alias("cut_bytes"))
    return e.join(blobs.where("name = sha"), F.col("full_sha256") == F.col("sha"), "left").select(
        "doc_id", F.col("full_sha256").isNotNull().alias("truncated"), F.octet_length("text").cast("long").alias("inline_bytes"), F.coalesce("cut_bytes", F.octet_length("text").cast("long")).alias("full_bytes"), "full_sha256", "stored_bytes"
    )


def role_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(paths.norm_role(F.col("role")).alias("role")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conv_id").alias("conversations"))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"), F.count("ts").alias("timed"), F.count_if(F.col("ts").isNull()).alias("untimed"))


def epoch_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written as seconds, milli-, micro- or nanoseconds by turns, and read back by their size."""
    from ..functions.times import parse_epoch

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", micros.alias("us"))
    written = F.when(F.col("event_id") % 4 == 0, F.expr("us div 1000000")).when(F.col("event_id") % 4 == 1, F.expr("us div 1000")).when(F.col("event_id") % 4 == 2, F.col("us")).otherwise(F.col("us") * 1000)
    return e.select("event_id", written.alias("written")).select("event_id", parse_epoch(F.col("written")).alias("ts_ns"))


def project_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the normal form of their site taken as a project remote."""
    remote = paths.normalize_remote(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1))
    return table(spark, sf_dir, "pages").groupBy(F.regexp_replace(remote, r"^www\.", "").alias("project")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stateful parser carries: the value of the user's last event whose number is divisible by three, onto later events.

    A user's events are one task's, as a session file's records are.
    """
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return e.select("event_id", "user_id", F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(w).alias("state"))


def occurrence_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


QUERIES = {f.__name__: f for f in (classify_duplicates, conflict_variants, observation_dedup, accounting_identity, redaction_counts, redacted_texts, truncate_spill, role_histogram, date_range, epoch_units, project_rollup, running_state, occurrence_number)}

_ROLE = """CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant'
  WHEN lower(trim(role)) IN ('tool', 'tool_result', 'function') THEN 'tool' WHEN lower(trim(role)) IN ('system', 'developer') THEN lower(trim(role)) ELSE 'other' END"""


def _redaction_sql() -> str:
    """redact.KINDS as a chain of replacements: each step counts its kind in what the ones before left."""
    steps = ["d0 AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN text || chr(10) || 'password=hunter2secret Authorization: Bearer abc.def-123' || chr(10) || 'sk-ant-api03-AbCdEfGhIjKlMnOpQr' ELSE text END AS t FROM documents)"]
    counts = []
    for k, (kind, pattern) in enumerate(redact.KINDS):
        own = pattern.replace("'", "''")
        mark = f"[REDACTED:{kind}]"
        if kind == "url_credentials":  # there is no look-around there
            own, mark = r"(://)[^/\s:@]+:[^/\s:@]+(@)", rf"\1{mark}\2"
        counts.append(f"SELECT '{kind}' AS kind, len(regexp_extract_all(t, '{own}')) AS n FROM d{k}")
        steps.append(f"d{k + 1} AS (SELECT doc_id, regexp_replace(t, '{own}', '{mark}', 'g') AS t FROM d{k})")
    return f"WITH {', '.join(steps)}", " UNION ALL ".join(counts), f"d{len(redact.KINDS)}"


_STEPS, _COUNTS, _LAST = _redaction_sql()
_CLASSIFIED = """
  WITH arrivals AS (SELECT doc_id AS ord, sha256(lower(substr(text, 1, 40))) AS event_id, sha256(text) AS content_fp, source AS source_id,
      CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 END AS record_index, lang AS parser FROM documents),
  based AS (SELECT *, first_value(content_fp) OVER (PARTITION BY event_id ORDER BY ord) AS base_fp,
      row_number() OVER (PARTITION BY event_id ORDER BY ord) AS k, row_number() OVER (PARTITION BY event_id, content_fp ORDER BY ord) AS j FROM arrivals),
  classified AS (SELECT *, CASE WHEN content_fp = base_fp THEN event_id ELSE 'v_' || substr(sha256(event_id || '|' || content_fp), 1, 24) END AS stored_id,
      CASE WHEN content_fp = base_fp THEN CASE WHEN k = 1 THEN 'new' ELSE 'duplicate' END WHEN j = 1 THEN 'variant_new' ELSE 'variant_duplicate' END AS status,
      CASE WHEN content_fp <> base_fp THEN event_id END AS variant_of FROM based)
"""
SQL = {
    "classify_duplicates": _CLASSIFIED + "SELECT ord, stored_id, status, variant_of FROM classified",
    "conflict_variants": _CLASSIFIED + "SELECT DISTINCT event_id, stored_id AS variant_event_id, content_fp, source_id FROM classified WHERE variant_of IS NOT NULL",
    "observation_dedup": _CLASSIFIED + "SELECT DISTINCT stored_id AS event_id, source_id, coalesce(record_index, -1) AS record_index, parser FROM classified",
    "accounting_identity": _CLASSIFIED
    + """, outcomes AS (SELECT source_id, CASE WHEN status IN ('new', 'variant_new') THEN 'imported' ELSE 'duplicate' END AS outcome FROM classified
        UNION ALL SELECT source, 'failed' FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
      SELECT source_id, count(*) AS examined, count(*) FILTER (outcome = 'imported') AS imported, count(*) FILTER (outcome = 'duplicate') AS duplicate,
        0::BIGINT AS skipped, count(*) FILTER (outcome = 'failed') AS failed, true AS balanced FROM outcomes GROUP BY source_id""",
    "redaction_counts": f"{_STEPS} SELECT kind, sum(n)::BIGINT AS hits, count(*) AS texts FROM ({_COUNTS}) WHERE n > 0 GROUP BY kind",
    "redacted_texts": f"{_STEPS} SELECT doc_id, sha256(t) AS text_sha256, sha256(t) AS scrubbed_sha256 FROM {_LAST}",
    "truncate_spill": f"""SELECT doc_id, strlen(text) > {LIMIT} AS truncated, strlen(text)::BIGINT AS full_bytes, CASE WHEN strlen(text) > {LIMIT} THEN sha256(text) END AS full_sha256, CASE WHEN strlen(text) > {LIMIT} THEN strlen(text) END AS stored_bytes,
        CASE WHEN strlen(text) <= {LIMIT} THEN strlen(text) ELSE (SELECT max(b) FROM (SELECT unnest([0, 1, 2, 3]) AS back, {LIMIT} - back AS b)
          WHERE substr(hex(encode(text)), 2 * b + 1, 1) NOT IN ('8', '9', 'A', 'B')) END::BIGINT AS inline_bytes FROM documents""",
    "role_histogram": f"SELECT {_ROLE} AS role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1",
    "date_range": "SELECT event_type, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts, count(ts) AS timed, count(*) FILTER (ts IS NULL) AS untimed FROM events GROUP BY event_type",
    "epoch_units": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000000 * 1000000000 WHEN 1 THEN epoch_us(ts) // 1000 * 1000000 ELSE epoch_us(ts) * 1000 END AS ts_ns FROM events""",
    "project_rollup": r"""SELECT regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') AS project, count(*) AS pages, min(page_id) AS first_page, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1""",
    "running_state": "SELECT event_id, user_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state FROM events",
    "occurrence_number": "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS occurrence FROM events",
}
