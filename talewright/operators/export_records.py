"""The exported records: content blocks, subagents, conversations and source references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import to_rfc3339

#: What of a part goes into its block, and under which name; JSON fields are put in as JSON.
_BLOCKS = {
    "text": (("text", "text"), ("truncation", "truncation")),
    "reasoning": (("text", "text"), ("visibility", "visibility")),
    "tool_call": (("id", "id"), ("name", "name"), ("arguments", "arguments_json")),
    "tool_result": (("call_id", "tool_call_id"), ("output", "output_json"), ("is_error", "is_error")),
    "image": (("artifact", "artifact"), ("mime", "mime"), ("filename", "filename"), ("source_ref", "source_ref")),
    "file_ref": (("path", "path"), ("artifact", "artifact"), ("mime", "mime"), ("filename", "filename")),
    "artifact": (("artifact", "artifact"), ("mime", "mime"), ("filename", "filename"), ("size", "size")),
    "data": (("value", "value_json"),),
    "opaque": (("kind", "kind"), ("note", "note"), ("raw", "raw_json")),
}
_TYPE = {"reasoning": "thinking", "image": "attachment", "file_ref": "attachment", "artifact": "attachment"}
_KIND = {"image": "image", "file_ref": "file", "artifact": "artifact"}


def _quoted(text: Column) -> Column:
    """A string as JSON, by way of a one-field object."""
    return F.expr("''") if text is None else F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^\{"v":([\s\S]*)\}$', 1)


def block(part: Column) -> Column:
    """A part as a block in JSON; absent fields are left out, a raw value that is null stays."""
    out = F.lit(None).cast("string")
    for kind, fields in _BLOCKS.items():
        pieces = [F.lit(f'"type":"{_TYPE.get(kind, kind)}"')]
        if kind in _KIND:
            pieces.append(F.lit(f'"kind":"{_KIND[kind]}"'))
        for name, source in fields:
            value = part[source]
            if source.endswith("_json"):
                text = value
            elif source in ("is_error", "size"):
                text = value.cast("string")
            elif source == "truncation":
                text = F.to_json(value)
            else:
                text = _quoted(value)
            pieces.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), text)))
        out = F.when(part["type"] == kind, F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))).otherwise(out)
    return out


def blocks(content: Column) -> Column:
    """The content as a JSON array."""
    return F.concat(F.lit("["), F.array_join(F.transform(content, block), ","), F.lit("]"))


def folded_confidence(detail: Column) -> Column:
    return F.when(detail == "exact", "exact").when(detail.isin("provider_derived", "database_derived", "filesystem_derived"), "derived").when(detail == "sequence_only", "sequence-only").otherwise("unknown")


def subagent(metadata: Column) -> Column:
    """Not null where a record is a side agent's: {is_subagent, agent_id, parent_session_id}."""
    get = lambda n: F.get_json_object(metadata, f"$.{n}")
    flag = (get("is_sidechain") == "true") | (get("is_subagent") == "true")
    some = F.coalesce(flag, F.lit(False)) | get("parent_session_id").isNotNull()
    return F.when(some, F.struct(F.coalesce(flag, F.lit(False)).alias("is_subagent"), get("agent_id").alias("agent_id"), get("parent_session_id").alias("parent_session_id")))


def source_refs(observation: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, source_refs): an event's observations in order of source, record and parser."""
    rows = observation.drop("source_path").join(sources.select("source_id", "source_path"), "source_id", "left")
    ref = F.struct("source_id", "record_index", "parser", "source_path", "import_run")
    return rows.groupBy("event_id").agg(F.sort_array(F.collect_list(ref)).alias("source_refs"))


def records(ordered: DataFrame, conversation: DataFrame, refs: DataFrame) -> DataFrame:
    """The full export's lines, in `ordered`'s order: every key present, missing values null.

    Conversations and references are joined before the sort: order by export.ORDER afterwards if rows were shuffled.
    """
    from .export import ORDER

    c = conversation.select("conversation_id", F.struct(F.col("title"), to_rfc3339(F.col("started_ns")).alias("started_at"), to_rfc3339(F.col("ended_ns")).alias("ended_at"), "event_count").alias("conversation"))
    first = F.struct(F.col("conversation.*"), (F.col("seq") == 0).alias("first_event"))
    out = ordered.join(c, "conversation_id", "left").join(refs, "event_id", "left")
    detail = F.when(F.col("ts_ns").isNull() & ~F.col("timestamp_confidence").isin("sequence_only", "unknown"), "unknown").otherwise(F.col("timestamp_confidence"))
    return out.select(
        F.lit("talewright.all/v1").alias("schema"), "event_id", "conversation_id", "session_id", "seq", "parent_event_id",
        to_rfc3339(F.col("ts_ns"), fixed=True).alias("timestamp"), "timestamp_original", folded_confidence(detail).alias("timestamp_confidence"), detail.alias("timestamp_confidence_detail"),
        *"event_type role application provider agent model".split(), subagent(F.col("metadata")).alias("subagent"), F.col("cwd").alias("working_directory"), "branch", F.when(F.col("conversation").isNotNull(), first).alias("conversation"),
        blocks(F.col("content")).alias("content"), "metadata", "source_refs", *ORDER[:4],
    ).orderBy(*ORDER).drop(*ORDER[:4])


def harness_conversations(events: DataFrame, conversation: DataFrame) -> DataFrame:
    """One record for each conversation that has events, by id."""
    seen = conversation.join(events, "conversation_id", "left_semi")
    return seen.select(F.lit("talewright.harness.conversation/v1").alias("schema"), "conversation_id", "title", to_rfc3339(F.col("started_ns")).alias("started_at"), to_rfc3339(F.col("ended_ns")).alias("ended_at")).orderBy("conversation_id")


def harness_refs(observation: DataFrame) -> DataFrame:
    """(event_id, source_refs): distinct (source_id, record_index) of an event's observations, in their order."""
    ref = F.struct("source_id", "record_index")
    return observation.groupBy("event_id").agg(F.sort_array(F.collect_set(ref)).alias("source_refs"))


def _object(always: dict[str, Column], optional: dict[str, Column]) -> Column:
    """A JSON object of values that are JSON already: the first are null where they are missing, the second left out."""
    pieces = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in always.items()]
    pieces += [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in optional.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def harness_record(e: DataFrame) -> Column:
    """The compact line of an event: e has the columns of export.hidden() and source_refs. Times of 0 and before count as missing."""
    text = lambda n: F.when(F.col(n).isNotNull(), _quoted(F.col(n))) if n in e.columns else F.lit(None).cast("string")
    timed = F.col("ts_ns").isNotNull()
    conf = F.when(timed | F.col("timestamp_confidence").isin("sequence_only", "unknown"), folded_confidence(F.col("timestamp_confidence"))).otherwise("unknown")
    place = [n for n in ("machine_id", "project_id", "repository_id") if n in e.columns]
    some = F.coalesce(*[F.col(n) for n in place]).isNotNull() if place else F.lit(False)
    side = subagent(F.col("metadata"))
    always = {
        "schema": F.lit('"talewright.harness/v1"'), "event_id": text("event_id"), "conversation_id": text("conversation_id"), "session_id": text("session_id"), "parent_event_id": text("parent_event_id"),
        "seq": F.col("seq").cast("string"), "timestamp": F.when(timed, _quoted(to_rfc3339(F.col("ts_ns"), fixed=True))), "timestamp_confidence": _quoted(conf), "role": text("role"),
        "event_type": F.when(F.col("control"), F.lit('"control"')).otherwise(text("event_type")), "provider": text("provider"), "application": text("application"), "model": text("model"), "content": blocks(F.col("content")),
    }
    optional = {n: F.when(some, F.coalesce(text(n), F.lit("null"))) for n in place}
    optional |= {"branch": text("branch"), "agent": text("agent"), "subagent": F.when(side.isNotNull(), F.to_json(side)), "hidden": F.col("hidden").cast("string"), "source_refs": F.when(F.size("source_refs") > 0, F.to_json("source_refs"))}
    return _object(always, optional)


def harness_lines(ordered: DataFrame, conversation: DataFrame, refs: DataFrame) -> DataFrame:
    """(line) of the compact export: conversations that have events, by id, then the events in their order."""
    from .export import ORDER

    heads = harness_conversations(ordered, conversation).select(F.to_json(F.struct("schema", "conversation_id", "title", "started_at", "ended_at"), {"ignoreNullFields": "false"}).alias("line"), F.lit(0).alias("part"), F.lit(None).cast("int").alias("grp"), F.lit(None).cast("long").alias("key_ns"), F.lit(None).cast("int").alias("key_rank"), F.col("conversation_id").alias("tie"), F.lit(0).cast("long").alias("seq"), F.lit("").alias("event_id"))
    events = ordered.join(refs, "event_id", "left")
    lines = events.select(harness_record(events).alias("line"), F.lit(1).alias("part"), *ORDER)
    return heads.unionByName(lines).orderBy("part", *ORDER).select("line")


def export_stats(ordered: DataFrame, arrived: DataFrame | None = None) -> DataFrame:
    """One row: events, duplicates that were dropped (records of `arrived` beyond the first of an id), those without a time, and a count by folded confidence."""
    conf = folded_confidence(F.col("timestamp_confidence"))
    out = ordered.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("ts_ns").isNull()).alias("null_timestamps"), *[F.count_if(conf == n).alias(n.replace("-", "_")) for n in "derived exact unknown sequence-only".split()])
    if arrived is None:
        return out
    return out.crossJoin(arrived.agg(F.count(F.lit(1)).alias("arrived"))).withColumn("duplicates", F.col("arrived") - F.col("events")).drop("arrived")
