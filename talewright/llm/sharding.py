"""Proportional stratified interleaving into shards, in DataFrame operations only.

Rows are put in a seeded order within their source, each gets its fractional rank
there, the sources are merged by that rank, and the merged order is cut into equal
runs. Each run holds every source in the corpus's proportion to within a row, and
shard sizes differ by at most one row (law ``rows``).

The seeded order goes by a hash of the text first, so equal texts stand next to each other
in their source, and at nearly the same rank in every source, and mostly share a shard.

Ranks are counted in two steps (rows before the bucket, then rows inside it), so no
task sorts a whole source: buckets are ranges of the seeded order and hold about `bucket_rows` rows
whatever the sources' sizes. A text that more rows share is parted from the others of its range and split
by ranges of the row's hash, so the order is the same at every size.

Cases: null sources are a source of their own; null texts have no bytes; repeated rows each get
a slot; fewer rows than shards leave shards empty; an empty table gives an
empty result; columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, quoted, without

RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _ranked(df: DataFrame, strata: list[str], buckets: list[str], order: list[Column], name: str) -> DataFrame:
    """df with `name`, the row's rank (from 0) in its stratum by buckets and then order."""
    groups = [*strata, *buckets]
    before = W.partitionBy(*strata) if strata else W.partitionBy()
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.select(*groups, (F.sum("__n").over(before.orderBy(*buckets).rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    inside = df.withColumn("__inside", F.row_number().over(W.partitionBy(*groups).orderBy(*order)) - 1)
    return inside.join(starts, groups).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def _range(digest: str, parts: int) -> Column:
    """The part (from 0) of the hexadecimal digest's values that holds the row; parts keep their order."""
    return F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("int")


def _split_hot(rows: DataFrame, parts: int, bucket_rows: int) -> DataFrame:
    """rows with __h, which parts texts of over bucket_rows rows from those before and after them in
    the range __b (odd for such a text), and __c, the range of their rows' hash."""
    hot = rows.groupBy("__source", "__b", "__order").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bucket_rows)
    by_range = hot.groupBy("__source", "__b").agg(F.collect_list("__order").alias("__hot"))  # few: a range holds about bucket_rows rows besides them
    found = rows.drop("__h", "__c").join(by_range, ["__source", "__b"], "left")
    is_hot = F.coalesce(F.array_contains("__hot", F.col("__order")), F.lit(False))
    before = F.coalesce(F.size(F.filter("__hot", lambda x: x < F.col("__order"))), F.lit(0))
    found = found.withColumn("__h", F.when(F.col("__hot").isNull(), 0).otherwise(before * 2 + is_hot.cast("int")))
    return found.withColumn("__c", F.when(is_hot, _range("__tie", parts)).otherwise(0)).drop("__hot")


def interleave(df: DataFrame, *, shards: int = 24, seed: int = 17, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", bucket_rows: int = 200_000) -> DataFrame:
    """df's columns but the text, with size, text_crc32, law, shard, slot and grown_shard."""
    text = quoted(text_col).cast("string")
    kept = without(df.drop(text_col), *RESULT)
    bytes_ = F.encode(text, "UTF-8")
    rows = df.select(
        *[quoted(c) for c in kept.columns],
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(bytes_, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), quoted(source_col).cast("string")), F.lit("")).alias("__source"),
        F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(text, F.lit("")))).alias("__order"),
        F.md5(F.concat_ws("\x1f", F.lit(str(seed)), quoted(id_col).cast("string"))).alias("__tie"),
    )
    rows = cut(rows, "shard-rows")  # narrow: every later pass is without the texts
    total = rows.count()
    by_text = max(1, total // bucket_rows)
    rows = rows.withColumn("__b", _range("__order", by_text)).withColumn("__h", F.lit(0)).withColumn("__c", F.lit(0))
    if by_text > 1:
        rows = _split_hot(rows, by_text, bucket_rows)
    sources = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__of"))
    ranked = _ranked(rows, ["__source"], ["__b", "__h", "__c"], [F.col("__order"), F.col("__tie")], "__rank").join(sources, "__source")
    # (2 rank + 1) / (2 n) to 18 digits; sources that tie in them go by name, then rank, so the order is fixed
    ranked = ranked.withColumn("__fraction", (F.col("__rank") * 2 + 1).cast("decimal(20,0)") / (F.col("__of") * 2).cast("decimal(19,0)"))
    ranked = ranked.withColumn("__f", F.least(F.lit(by_text - 1), F.floor(F.col("__fraction") * by_text)).cast("int"))
    placed = _ranked(ranked, [], ["__f"], [F.col("__fraction"), F.col("__source"), F.col("__rank")], "__place")
    shard = F.floor(F.col("__place") * shards / F.lit(max(1, total)))
    shard = F.expr(f"__place * {shards} div {max(1, total)}").cast("int")
    first = F.expr(f"((__place * {shards} div {max(1, total)}) * {max(1, total)} + {shards - 1}) div {shards}")
    return placed.select(
        *[quoted(c) for c in kept.columns],
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.alias("shard"),
        (F.col("__place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
