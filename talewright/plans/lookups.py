"""Export order and search over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import kept
from ..operators import export, search
from .records import table


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a conversation of each user; two of three lose their time, the parent is the event before."""
    e = table(spark, sf_dir, "events")
    w = W.partitionBy("user_id").orderBy("event_id")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("conversation_id"),
        F.lit(None).cast("string").alias("session_id"),
        (F.row_number().over(w) - 1).cast("long").alias("seq"),
        F.when(F.col("event_id") % 3 == 0, F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        F.when(F.col("event_id") % 3 == 0, "exact").otherwise("unknown").alias("timestamp_confidence"),
        F.lag("event_id").over(w).cast("string").alias("parent_event_id"),
        F.lit(None).cast("string").alias("parent_native_id"),
        F.lit(None).cast("string").alias("native_id"),
        F.col("event_id").alias("shard_ord"),
    )


def anchor_untimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).withColumn("rank", F.when(F.col("ts_ns").isNotNull(), 0).otherwise(5))
    return export.anchored(e).select("event_id", "anchor_ns", "anchor_rank")


def chronological_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.chronological(user_events(spark, sf_dir)).select("event_id", "grp", "key_ns", "key_rank", "tie", "seq")


def _index(spark: SparkSession, sf_dir: str, folded: bool = False) -> search.Index:
    """The stored postings of documents, written once for a session and set of tables."""

    def build(folder: str) -> search.Index:
        search.write_index(table(spark, sf_dir, "documents"), folder, id_col="doc_id", folded=folded)
        return search.Index(spark, folder)

    return kept(spark, ("index", sf_dir, folded), build)


def search_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).match([["the"], ["of"], ["pathetic"]]).select(F.col("id").alias("doc_id"))


def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).match([["of", "the"], ["and", "the"]]).select(F.col("id").alias("doc_id"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _index(spark, sf_dir).bm25([["pathetic"], ["clown"]], limit=20)
    return best.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


def search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with diacritics and upper case: both sides are folded."""
    return _index(spark, sf_dir, folded=True).match("\"ÉT\" Où").select(F.col("id").alias("doc_id"))


def postings_unstored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings straight from the texts, counted by term; the stored ones are the same."""
    index = _index(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), search.tokens(F.col("text"), False).alias("tokens"))
    # a row of places for each term of a text: added up before the shuffle
    fresh = search.places(docs).groupBy("term").agg(F.sum(F.size("places")).alias("n"), F.count(F.lit(1)).alias("texts"))
    stored = index.by_term.groupBy("term").agg(F.sum(F.size("places")).alias("stored"))
    return fresh.join(stored, "term", "left").select("term", "n", "texts", "stored")


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 words of each English text around its first "of", as the snippet shows them."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"[^A-Za-z]+", " ").alias("text"), F.lit(0.0).alias("rank"))
    shown = search.with_previews(docs.select("id", "rank"), docs.select("id", "text"), "of")
    return shown.select(F.col("id").alias("doc_id"), "preview")


def harness_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the compact export: ties by conversation and session, times of 0 and before count as missing."""
    e = user_events(spark, sf_dir).withColumn("ts_ns", F.when(F.col("event_id").cast("long") % 9 == 0, F.lit(0)).otherwise(F.col("ts_ns"))).withColumn("session_id", F.concat(F.lit("s"), F.col("conversation_id")))
    return export.chronological(e, harness=True).select("event_id", "grp", "key_ns", "key_rank", "tie", "seq")


def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards that hold every fifth event twice: the first record of an id counts."""
    e = user_events(spark, sf_dir)
    again = e.where(F.col("event_id").cast("long") % 5 == 0).withColumn("seq", F.lit(-1).cast("long")).withColumn("shard_ord", F.col("shard_ord") + 1_000_000_000)
    return export.distinct_events(e.unionByName(again)).select("event_id", "seq")


QUERIES = {f.__name__: f for f in (anchor_untimed, chronological_export, search_and_terms, search_phrase, bm25_topk, search_folded, postings_unstored, previews, harness_order, repeated_events)}

_EVENTS = """
  WITH e AS (SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS conversation_id, row_number() OVER w - 1 AS seq,
      CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) * 1000 END AS ts_ns, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  a AS (SELECT *, last_value(ts_ns IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY seq ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS anchor_ns FROM e)
"""
_POSTINGS = r"""
  WITH tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{Co}]+') AS t FROM documents),
  postings AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM tokens)
"""
SQL = {
    "anchor_untimed": _EVENTS + "SELECT event_id, anchor_ns, CASE WHEN anchor_ns IS NULL THEN 5 ELSE 0 END AS anchor_rank FROM a",
    "chronological_export": _EVENTS
    + """SELECT event_id, CASE WHEN anchor_ns IS NULL THEN 1 ELSE 0 END AS grp, coalesce(anchor_ns, 0) AS key_ns, CASE WHEN anchor_ns IS NULL THEN 5 ELSE 0 END AS key_rank,
        CASE WHEN anchor_ns IS NULL THEN conversation_id ELSE '' END AS tie, seq FROM a ORDER BY grp, key_ns, key_rank, tie, seq, event_id""",
    "search_folded": r"""WITH f AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}\p{Co}]+') AS t FROM documents) SELECT doc_id FROM f WHERE list_contains(t, 'et') AND list_contains(t, 'ou')""",
    "postings_unstored": _POSTINGS + "SELECT term, count(*) AS n, count(DISTINCT doc_id) AS texts, count(*) AS stored FROM postings GROUP BY term",
    "previews": r"""WITH d AS (SELECT doc_id, string_split(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), ' ') AS w FROM documents WHERE lang = 'en'),
      p AS (SELECT doc_id, w, greatest(coalesce(list_position(list_transform(w, lambda x: contains(lower(x), 'of')), true), 1) - 1 - 8, 0) AS a FROM d) SELECT doc_id, left(array_to_string(w[a + 1:a + 16], ' '), 400) AS preview FROM p""",
    "harness_order": _EVENTS.replace("CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) * 1000 END", "CASE WHEN event_id % 3 = 0 AND event_id % 9 <> 0 THEN epoch_us(ts) * 1000 END")
    + """SELECT event_id, CASE WHEN anchor_ns IS NULL THEN 1 ELSE 0 END AS grp, coalesce(anchor_ns, 0) AS key_ns, CASE WHEN anchor_ns IS NULL THEN 5 ELSE 0 END AS key_rank, conversation_id || '/s' || conversation_id AS tie, seq FROM a""",
    "repeated_events": _EVENTS + "SELECT event_id, seq FROM e",
    "search_and_terms": _POSTINGS + "SELECT doc_id FROM postings WHERE term IN ('the', 'of', 'pathetic') GROUP BY doc_id HAVING count(DISTINCT term) = 3",
    "search_phrase": _POSTINGS
    + """SELECT DISTINCT a.doc_id FROM postings a JOIN postings b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 AND a.term = 'of' AND b.term = 'the'
        WHERE a.doc_id IN (SELECT c.doc_id FROM postings c JOIN postings d ON d.doc_id = c.doc_id AND d.pos = c.pos + 1 AND c.term = 'and' AND d.term = 'the')""",
    "bm25_topk": _POSTINGS
    + """, sizes AS (SELECT doc_id, count(*) AS size FROM postings GROUP BY doc_id), whole AS (SELECT count(*) AS n, avg(size) AS av FROM sizes),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM postings WHERE term IN ('pathetic', 'clown') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      both_ AS (SELECT doc_id FROM tf GROUP BY doc_id HAVING count(*) = 2)
      SELECT doc_id, round(-sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / av))), 6) AS rank
      FROM tf JOIN df USING (term) JOIN sizes USING (doc_id), whole WHERE doc_id IN (SELECT doc_id FROM both_) GROUP BY doc_id ORDER BY rank, doc_id LIMIT 20""",
}
