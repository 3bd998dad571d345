"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talewright.llm import language, order_minhash, packing, quality, suffix_dedup
from talewright.llm.common import cut, quoted, table


_READ = ("doc_id", "text", "lang")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with the columns that no stage reads under names that no operator's results have."""
    return docs.select(*[quoted(c).alias(c if c in _READ else f"__c{i}") for i, c in enumerate(docs.columns)])


def _back(done: DataFrame, docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of docs again; with another text and its number of characters, if one is given."""
    new = {} if text is None else {"text": text, "n_chars": F.length(text).cast("long")}
    return done.select(*[new.get(c, F.col(c if c in _READ else f"__c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; so do documents that fail the base rules or lose too much text."""
    return _back(quality.clean(_aside(docs)).where("kept"), docs, F.col("clean_text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too far from every language's centroids, go."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return _back(language.predict(_aside(docs), model).where(~F.col("rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least doc_id."""
    return _back(order_minhash.deduplicated(_aside(docs)), docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice or more are cut out (whole characters only); documents stay, if empty."""
    done = suffix_dedup.remove_repeats(_aside(docs), whole_characters=True)
    return _back(done, docs, F.col("kept").cast("string"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("packing", pack),
]

#: Language vectors, sketches, suffixes and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
