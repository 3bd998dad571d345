"""The chronological export: parents, anchors of untimed events, and the global order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import confidence_rank
from ..lineage import cut

MAX_ANCESTORS = 21


def distinct_events(events: DataFrame, *, order: str = "shard_ord") -> DataFrame:
    """The first record of each event id, in the order of the shards. Ids are counted alone; only records of repeated ones meet."""
    often = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("event_id")
    often = cut(often, "often")
    if often.isEmpty():
        return events
    cols = [c for c in events.columns if c != "event_id"]
    once = events.join(often, "event_id", "left_anti")
    first = events.join(often, "event_id", "left_semi").groupBy("event_id").agg(F.min_by(F.struct(*cols), F.col(order)).alias("r")).select("event_id", "r.*")
    return once.unionByName(first)


def with_parents(events: DataFrame) -> DataFrame:
    """events with parent_event_id: its own, else the first event of its conversation with the native id it names.

    Rows that name no parent take no part in the join.
    """
    named = events.where("native_id is not null").groupBy("conversation_id", F.col("native_id").alias("parent_native_id")).agg(F.min_by("event_id", "shard_ord").alias("named_parent"))
    asks = F.col("parent_native_id").isNotNull() & F.col("parent_event_id").isNull()
    found = events.where(asks).join(named, ["conversation_id", "parent_native_id"], "left").withColumn("parent_event_id", F.col("named_parent"))
    return found.select(events.columns).unionByName(events.where(~asks))


def anchored(events: DataFrame, *, id_col: str = "event_id", parent_col: str = "parent_event_id", ts_col: str = "ts_ns", rank_col: str = "rank", depth: int = MAX_ANCESTORS) -> DataFrame:
    """events with anchor_ns and anchor_rank: the own time, else the nearest timed ancestor's, at most `depth` up.

    Ancestors are followed by pointer doubling: after each round a row knows its nearest timed ancestor within twice the
    distance, or where to go on. Only untimed rows with a parent take part, only those that go on are joined and written
    again, and cycles end with the distance.
    """
    events = cut(events.withColumn("__own", F.col(ts_col).isNotNull()), "events")
    up = events.where(~F.col("__own") & F.col(parent_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(parent_col).alias("next"))
    timed = events.where("__own").select(F.col(id_col).alias("next"), F.struct(F.col(ts_col).alias("ts"), F.col(rank_col).alias("rank")).alias("hit"))
    # per row: the nearest timed ancestor found within `step` steps, or the row after them
    state = up.join(timed, "next", "left").select("id", "hit", F.when(F.col("hit").isNull(), F.col("next")).alias("next"), F.lit(1).alias("step"))
    state = cut(state, "anchors")
    done, pending, reach = state.where("next is null"), state.where("next is not null"), 1
    while reach <= depth and not pending.isEmpty():
        other = done.unionByName(pending).select(F.col("id").alias("next"), F.col("hit").alias("o_hit"), F.col("next").alias("o_next"), F.col("step").alias("o_step"))
        moved = pending.join(other, "next", "left").select(
            "id",
            F.col("o_hit").alias("hit"),
            F.col("o_next").alias("next"),
            (F.col("step") + F.coalesce("o_step", F.lit(0))).alias("step"),
        )
        moved = cut(moved, "anchors")
        done, pending = done.unionByName(moved.where("next is null")), moved.where("next is not null")
        reach *= 2
    found = done.where(F.col("hit").isNotNull() & (F.col("step") <= depth)).select(F.col("id").alias(id_col), "hit")
    out = events.join(found, id_col, "left")
    return (
        out.withColumn("anchor_ns", F.when(F.col("__own"), F.col(ts_col)).otherwise(F.col("hit.ts")))
        .withColumn("anchor_rank", F.when(F.col("__own"), F.col(rank_col)).otherwise(F.coalesce("hit.rank", rank_col)))
        .drop("__own", "hit")
    )


def sort_key(events: DataFrame, *, harness: bool = False) -> DataFrame:
    """events with the columns of the global order: grp, key_ns, key_rank, tie (then seq and event_id)."""
    timed = F.col("anchor_ns").isNotNull()
    tie = F.concat_ws("/", "conversation_id", F.coalesce("session_id", F.lit(""))) if harness else F.when(timed, "").otherwise(F.col("conversation_id"))
    return (
        events.withColumn("grp", F.when(timed, 0).otherwise(1))
        .withColumn("key_ns", F.coalesce("anchor_ns", F.lit(0)).cast("long"))
        .withColumn("key_rank", F.col("anchor_rank"))
        .withColumn("tie", tie)
    )


ORDER = ("grp", "key_ns", "key_rank", "tie", "seq", "event_id")


def chronological(events: DataFrame, *, harness: bool = False) -> DataFrame:
    """All events in one order. events: event_id, conversation_id, session_id, seq, ts_ns, timestamp_confidence, parent_event_id, parent_native_id, native_id, shard_ord.

    The order is a range-partitioned sort: no task holds more than its range.
    """
    once = distinct_events(events)
    usable = F.col("ts_ns").isNotNull() & ((F.col("ts_ns") > 0) if harness else F.lit(True))
    once = once.withColumn("ts_ns", F.when(usable, F.col("ts_ns")))
    once = once.withColumn("rank", F.when(F.col("ts_ns").isNull() & ~F.col("timestamp_confidence").isin("sequence_only", "unknown"), 5).otherwise(confidence_rank(F.col("timestamp_confidence"))))
    return sort_key(anchored(with_parents(once)), harness=harness).orderBy(*ORDER)


def hidden(events: DataFrame) -> DataFrame:
    """events(event_type, metadata, text) with control and hidden, as the compact export marks them."""
    flag = lambda names: F.exists(F.array(*[F.get_json_object("metadata", f"$.{n}") == "true" for n in names]), lambda x: F.coalesce(x, F.lit(False)))
    start = F.ltrim(F.coalesce("text", F.lit("")))
    control = (F.col("event_type") == "control") | flag(("is_control", "is_meta", "is_system_reminder", "is_injected", "is_context")) | start.startswith("<system-reminder>") | start.startswith("<control>")
    return events.withColumn("control", control).withColumn("hidden", control | (F.col("event_type") == "compaction") | flag(("hidden", "is_hidden", "is_compact_summary", "inactive", "is_sidechain")))
