"""Classification of arriving events against the archive: new, duplicate or conflicting variant.

The first arrival of an event id (or its archived record) is the base. Arrivals with the base's content are duplicates;
others are variants, each content of which is new once. Content alone never merges two ids.

The base of an id comes from a grouped minimum over the arrival order, which is added up before the shuffle and
joined back, so that an id that very many arrivals share is split by adaptive execution instead of
sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import variant_id


def classify(arrivals: DataFrame, archived: DataFrame | None = None, *, order: str = "ord", variant: Callable[[Column, Column], Column] = variant_id) -> DataFrame:
    """arrivals(event_id, content_fp, <order>, ...) with base_fp, status, stored_id and variant_of.

    archived(event_id, content_fp) holds what is stored already, variants included. status is new, duplicate, variant_new or
    variant_duplicate; stored_id is the id under which the arrival counts. <order> must be unique.
    """
    first = arrivals.groupBy("event_id").agg(F.min_by("content_fp", order).alias("first_fp"), F.min(order).alias("first_ord"))
    if archived is None:
        base = first.select("event_id", F.col("first_fp").alias("base_fp"), "first_ord", F.lit(False).alias("stored"))
    else:
        known = archived.groupBy("event_id").agg(F.min("content_fp").alias("known_fp"))
        base = first.join(known, "event_id", "left").select("event_id", F.coalesce("known_fp", "first_fp").alias("base_fp"), "first_ord", F.col("known_fp").isNotNull().alias("stored"))
    rows = arrivals.join(base, "event_id")
    same = F.col("content_fp") == F.col("base_fp")
    rows = rows.withColumn("stored_id", F.when(same, F.col("event_id")).otherwise(variant(F.col("event_id"), F.col("content_fp"))))
    firsts = rows.where(~same).groupBy("event_id", "content_fp").agg(F.min(order).alias("variant_ord"))
    if archived is not None:
        kept = archived.select(F.col("event_id").alias("stored_id")).distinct().withColumn("variant_stored", F.lit(True))
        rows = rows.join(kept, "stored_id", "left")
    else:
        rows = rows.withColumn("variant_stored", F.lit(None).cast("boolean"))
    rows = rows.join(firsts, ["event_id", "content_fp"], "left")
    status = (
        F.when(same, F.when(~F.col("stored") & (F.col(order) == F.col("first_ord")), "new").otherwise("duplicate"))
        .when(F.col("variant_stored").isNull() & (F.col(order) == F.col("variant_ord")), "variant_new")
        .otherwise("variant_duplicate")
    )
    return rows.withColumn("status", status).withColumn("variant_of", F.when(~same, F.col("event_id"))).drop("first_ord", "variant_ord", "stored", "variant_stored")


OBSERVATION_KEY = ("event_id", "source_id", "record_index", "parser")


def observations(classified: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """One row per (stored event, source, record or -1, parser) that the archive doesn't have."""
    rows = classified.withColumn("event_id", F.col("stored_id")).withColumn("record_index", F.coalesce("record_index", F.lit(-1)))
    rows = rows.dropDuplicates(list(OBSERVATION_KEY))
    if archived is None:
        return rows
    known = archived.select("event_id", "source_id", F.coalesce("record_index", F.lit(-1)).alias("record_index"), "parser").distinct()
    mine = rows.alias("a")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in OBSERVATION_KEY]
    return mine.join(known.alias("b"), same, "left_anti")


def conflicts(classified: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """Distinct (event_id, variant_event_id, content_fp, source_id) of variants that the archive doesn't have."""
    rows = classified.where("variant_of is not null").select("event_id", F.col("stored_id").alias("variant_event_id"), "content_fp", "source_id").distinct()
    return rows if archived is None else rows.join(archived, ["event_id", "variant_event_id", "content_fp", "source_id"], "left_anti")


def accounting(classified: DataFrame, failed: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """Per source: examined = imported + duplicate + skipped + failed, with whether the identity holds."""
    none = classified.sparkSession.createDataFrame([], "source_id string")
    parts = classified.select("source_id", F.when(F.col("status").isin("new", "variant_new"), "imported").otherwise("duplicate").alias("outcome"))
    for df, name in ((failed, "failed"), (skipped, "skipped")):
        parts = parts.unionByName((none if df is None else df).select("source_id", F.lit(name).alias("outcome")))
    out = parts.groupBy("source_id").agg(F.count(F.lit(1)).alias("examined"), *[F.count_if(F.col("outcome") == n).alias(n) for n in ("imported", "duplicate", "skipped", "failed")])
    return out.withColumn("balanced", F.col("examined") == F.col("imported") + F.col("duplicate") + F.col("skipped") + F.col("failed"))
