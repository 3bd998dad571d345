"""Pages as Markdown, and conversations through the whole import path."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from .records import table


def markdown_of(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, markdown) of HTML texts, in Arrow batches."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.exports import markdown

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([markdown(h or "") for h in b.column(1).to_pylist()], pa.string())], names=[id_col, "markdown"])

    return df.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, markdown string")


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): each conversation as a file of lines, as a tool would have written it."""
    turns = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("id"), "role", F.col("text").alias("content")))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("rows"))
    return rows.select(F.format_string("/conversations/%d.jsonl", "conv_id").alias("path"), F.encode(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), "UTF-8").alias("content"))


def imported_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, parsing, redaction, sequence and identity over those files; sequence numbers, roles and texts have SQL."""
    e = ingest.events(ingest.drafts(conversation_files(spark, sf_dir), keep_secrets=True), max_inline=0)
    return e.select(F.regexp_extract("source_path", r"(\d+)", 1).cast("long").alias("conv_id"), "seq", "role", F.sha2(F.get("content", F.lit(0))["text"], 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (imported_conversations,)}
SQL = {
    "imported_conversations": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
        CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant'
          WHEN lower(trim(role)) IN ('tool', 'tool_result', 'function') THEN 'tool' WHEN lower(trim(role)) IN ('system', 'developer') THEN lower(trim(role)) ELSE 'other' END AS role,
        sha256(text) AS text_sha256 FROM conversations"""
}
