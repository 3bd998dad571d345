"""Full-text search: a stored postings table, conjunctions, phrases and BM25."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
K1, B = 1.2, 0.75
#: Tokens of a bucket of terms, and the most buckets.
BUCKET_TOKENS, MOST_BUCKETS = 50_000_000, 4096
#: Tokens that a task writes, as a file of its bucket, and those that are grouped at a time before.
TASK_TOKENS, PIECE_TOKENS = 2_000_000, 1 << 20


def fold(text: str) -> str:
    """Lower case without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


@F.pandas_udf(StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


def tokens(text: F.Column, folded: bool) -> F.Column:
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(fold_udf(text)) if folded else F.lower(text)
    return F.regexp_extract_all(plain, F.lit(TOKEN), 0)


def postings(docs: DataFrame, *, id_col: str = "event_id", text_col: str = "text", folded: bool = True) -> DataFrame:
    """(id, pos, term) of every token. folded: drop diacritics in Arrow batches; else lower case only, in the JVM."""
    return docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col), folded)).alias("pos", "term"))


def places(tokened: DataFrame) -> DataFrame:
    """(id, term, places) of (id, tokens): a row for each different token of a text, without a shuffle. Texts of one id are taken together.

    Arrow batches, as grouping inside of a row has no built-in that isn't quadratic; PIECE_TOKENS are sorted at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + PIECE_TOKENS, side="right")))
                sizes = np.diff(ends[at:to], prepend=before)
                flat = lists.slice(at, to - at).flatten().dictionary_encode()
                row, code = np.repeat(np.arange(to - at), sizes), flat.indices.to_numpy(zero_copy_only=False)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                key = row * max(1, len(flat.dictionary)) + code
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                own = order[first]
                found = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(pos[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at).take(pa.array(row[own])), flat.dictionary.take(pa.array(code[own])), found], names=["id", "term", "places"])
                at = to

    each = tokened.select("id", "tokens").mapInArrow(run, f"id {tokened.schema['id'].dataType.simpleString()}, term string, places array<int>")
    if tokened.groupBy("id").count().where("count > 1").isEmpty():
        return each
    return each.groupBy("id", "term").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))


def bucket_of(term: F.Column, buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_index(docs: DataFrame, folder: str, *, id_col: str = "event_id", text_col: str = "text", folded: bool = True) -> int:
    """Store the postings of docs below a folder: term by term in buckets, and the texts' sizes beside; gives the number of texts.

    A posting is a term's places in one text. A query reads the buckets of its terms, and of those the row groups that hold them.
    """
    # tokens are made once: sizes and postings are read from them
    docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col), folded).alias("tokens")).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/tokens")
    made = docs.sparkSession.read.parquet(f"{folder}/tokens")
    made.select("id", F.size("tokens").alias("size")).where("size > 0").write.mode("overwrite").parquet(f"{folder}/sizes")
    sizes = docs.sparkSession.read.parquet(f"{folder}/sizes")
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{folder}/whole")
    total = docs.sparkSession.read.parquet(f"{folder}/whole").first()
    buckets = max(1, min(MOST_BUCKETS, total.tokens // BUCKET_TOKENS))
    each = places(made).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # one shuffle, to equal tasks whose rows are sorted in memory; a bucket's texts are parted among its own
    own = max(1, -(-total.tokens // (buckets * TASK_TOKENS)))
    spread = each.repartitionById(buckets * own, (F.col("bucket") * own + F.pmod(F.xxhash64("id"), F.lit(own))).cast("int"))
    spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{folder}/postings")
    return total.n


class Index:
    """Postings that write_index() stored."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.by_term = spark.read.parquet(f"{folder}/postings")
        self.buckets = (self.by_term.agg(F.max("bucket")).first()[0] or 0) + 1
        self.sizes = spark.read.parquet(f"{folder}/sizes")
        self.whole = spark.read.parquet(f"{folder}/whole")

    def of(self, terms: list[str]) -> DataFrame:
        """(id, term, places) of some terms; other buckets aren't read."""
        if not terms:
            return self.by_term.select("id", "term", "places").limit(0)
        own = self.spark.range(1).select(*[bucket_of(F.lit(t), self.buckets) for t in terms]).first()
        return self.by_term.where(F.col("bucket").isin(sorted(set(own))) & F.col("term").isin(terms)).select("id", "term", "places")

    def postings(self, terms: list[str]) -> DataFrame:
        return self.of(terms).select("id", F.explode("places").alias("pos"), "term")

    def match(self, query: str | list[list[str]]) -> DataFrame:
        wanted = phrases(query) if isinstance(query, str) else query
        return match(self.postings(_terms(wanted)), wanted)

    def bm25(self, query: str | list[list[str]], *, limit: int = 20, k1: float = K1, b: float = B) -> DataFrame:
        """As bm25() over the whole postings."""
        wanted = phrases(query) if isinstance(query, str) else query
        tf = self.of(_terms(wanted)).select("id", "term", F.size("places").alias("tf"))
        return _scored(tf, self.match(wanted), self.sizes, self.whole, limit, k1, b)


def phrases(query: str) -> list[list[str]]:
    """The query's words, each a phrase of its tokens; quotes and control signs are ignored."""
    import regex

    words = ["".join(c for c in w if c != '"' and unicodedata.category(c) != "Cc") for w in query.split()]
    return [t for t in (regex.findall(TOKEN, fold(w)) for w in words) if t]


def _terms(wanted: list[list[str]]) -> list[str]:
    return sorted({t for p in wanted for t in p})


def match(index: DataFrame, query: str | list[list[str]]) -> DataFrame:
    """Distinct ids that hold every phrase; none for an empty query.

    Postings are filtered to the query's terms first; a phrase is a run of positions, found by grouping positions less
    their place in the phrase.
    """
    wanted = phrases(query) if isinstance(query, str) else query
    if not wanted:
        return index.select("id").limit(0)
    rows = [(n, k, t) for n, p in enumerate(wanted) for k, t in enumerate(p)]
    place = F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(k).alias("k"), F.lit(t).alias("t")) for n, k, t in rows])
    hit = index.where(F.col("term").isin(sorted({t for _, _, t in rows}))).select("id", "pos", F.explode(F.filter(place, lambda x: x["t"] == F.col("term"))).alias("x"))
    runs = hit.groupBy("id", F.col("x.phrase").alias("phrase"), (F.col("pos") - F.col("x.k")).alias("start")).agg(F.countDistinct("x.k").alias("n"))
    sizes = F.element_at(F.array(*[F.lit(len(p)) for p in wanted]), F.col("phrase") + 1)
    return runs.where(F.col("n") == sizes).groupBy("id").agg(F.countDistinct("phrase").alias("found")).where(F.col("found") == len(wanted)).select("id")


def _scored(tf: DataFrame, matched: DataFrame, sizes: DataFrame, whole: DataFrame, limit: int, k1: float, b: float) -> DataFrame:
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("avg")))
    scored = tf.join(matched, "id", "left_semi").join(df, "term").join(sizes, "id").crossJoin(F.broadcast(whole.select("n", "avg"))).groupBy("id").agg((-F.sum(part)).alias("rank"))
    return scored.orderBy("rank", "id").limit(max(1, min(1000, limit)))


def bm25(index: DataFrame, query: str | list[list[str]], *, limit: int = 20, k1: float = K1, b: float = B) -> DataFrame:
    """(id, rank) of the best matches; rank is negative, lower is better, ties by id. limit is kept in 1 to 1000."""
    wanted = phrases(query) if isinstance(query, str) else query
    terms = _terms(wanted)
    sizes = index.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg"))
    tf = index.where(F.col("term").isin(terms) if terms else F.lit(False)).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _scored(tf, match(index, wanted), sizes, whole, limit, k1, b)


def preview(text: str, query: str, around: int = 16, most: int = 400) -> str:
    """The tokens around the first hit, on one line."""
    words = re.sub(r"\s+", " ", text).split(" ")
    terms = {t for p in phrases(query) for t in p}
    at = next((k for k, w in enumerate(words) if any(t in fold(w) for t in terms)), 0)
    start = max(0, at - around // 2)
    return " ".join(words[start : start + around])[:most]


def with_previews(best: DataFrame, texts: DataFrame, query: str) -> DataFrame:
    """best(id, rank) with preview, in order of rank: what stands around the first hit in texts(id, text)."""

    @F.pandas_udf(StringType())
    def shown(text: pd.Series) -> pd.Series:
        return text.map(lambda t: preview(t or "", query))

    return texts.join(F.broadcast(best), "id").select("id", "rank", shown("text").alias("preview")).orderBy("rank", "id")
