"""The opN_<name> queries over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, order_minhash, packing, piece_agenda, quality, sharding, simhash, suffix_dedup, url_filter, warc_zip
from .common import cut, table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharding.interleave(docs, shards=24).drop("source")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc_zip.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    sha = F.sha1("payload")
    records = cut(back.select(F.col("key").cast("long").alias("page_id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"), "header_digest", F.octet_length("payload").cast("long").alias("held"), sha.alias("sha")), "records")
    # a revisit's size is its response's: what is read of that one counts, not a header
    full = records.where("record_type = 'response'").groupBy("header_digest").agg(F.max("held").alias("full"), F.max("sha").alias("full_sha"))
    return records.join(full, "header_digest", "left").select(
        "page_id",
        F.coalesce("full", "held").alias("payload_bytes"),
        warc_zip.base32(F.coalesce("full_sha", "sha")).alias("payload_digest"),
        "record_type",
        F.when(F.col("record_type") == "revisit", F.col("refers_to")).alias("refers_to"),
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {_RULES} AS rules(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "kept")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_agenda.encode_decode(docs, check=True)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_sharding": op3_sharding,
        "op4_packing": op4_packing,
        "op5_warc": op5_warc,
        "op6_url_filter": op6_url_filter,
        "op7_fingerprints": op7_fingerprints,
        "op8_near_dedup": op8_near_dedup,
        "op9_quality": op9_quality,
        "op10_language": op10_language,
    }


_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6_SQL = f"""
  WITH rules(h, p, v) AS (VALUES {_RULES}),
  rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
  parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
  hits AS (SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS verdict
    FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
  SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN hits USING (page_id)"""

_BOILERPLATE = quality.BOILERPLATE.replace("'", "''")
OP9_SQL = rf"""
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS trims,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
  windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
  again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
  covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM again, unnest(range(i, i + 5)) AS u(j) GROUP BY doc_id),
  judged AS (SELECT doc_id, length(x) AS size, x <> '' AND (NOT contains('{quality.ENDS.replace("'", "''")}', right(x, 1)) OR (upper(x) = x AND lower(x) <> x AND length(x) >= 10)
      OR len(regexp_extract_all(x, '[#*$%&|<>=_~^]')) * 10 > length(x)
      OR len(regexp_extract_all(x, '\p{{L}}')) * 2 < length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))
      OR regexp_matches(x, '{quality.SEPARATORS}') OR regexp_matches(x, '{quality.CAPITALS}') OR regexp_matches(lower(x), '{_BOILERPLATE}')) AS fails FROM w, unnest(trims) AS u(x)),
  lost AS (SELECT doc_id, coalesce(sum(size) FILTER (fails), 0) / nullif(sum(size), 0) AS share FROM judged GROUP BY doc_id),
  base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[{quality.SYMBOLS}]'))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id))
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (SELECT coalesce(share, 0) <= {quality.MAX_LOST} FROM lost WHERE lost.doc_id = base.doc_id) AS kept FROM base"""


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_quality": OP9_SQL}
