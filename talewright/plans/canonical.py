"""Canonical events of the conversations table: roles, sequence numbers, types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    role = F.lower(F.trim("role"))
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.when(role.isin("user", "human"), "user")
        .when(role.isin("assistant", "ai", "model", "bot"), "assistant")
        .when(role.isin("tool", "tool_result", "function"), "tool")
        .when(role.isin("system", "developer"), role)
        .otherwise("other")
        .alias("role"),
        F.lit("message").alias("event_type"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"),
    )


QUERIES = {"canonical_events": canonical_events}
SQL = {
    "canonical_events": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq,
          CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
               WHEN lower(trim(role)) IN ('assistant', 'ai', 'model', 'bot') THEN 'assistant'
               WHEN lower(trim(role)) IN ('tool', 'tool_result', 'function') THEN 'tool'
               WHEN lower(trim(role)) IN ('system', 'developer') THEN lower(trim(role)) ELSE 'other' END AS role,
          'message' AS event_type, sha256(coalesce(text, '')) AS content_sha256
        FROM conversations"""
}
