"""Schemas of canonical events and shaping of their content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_INLINE = 32 * 1024

TRUNCATION = T.StructType([T.StructField("full_sha256", T.StringType()), T.StructField("full_bytes", T.LongType()), T.StructField("inline_bytes", T.LongType()), T.StructField("artifact", T.StringType())])
#: All kinds of parts in one struct, told apart by `type`; JSON values are canonical strings.
PART = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "text", "visibility", "id", "name", "arguments_json", "tool_call_id", "output_json", "artifact", "mime", "filename", "source_ref", "path", "value_json", "kind", "note", "raw_json")]
    + [T.StructField("is_error", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("truncation", TRUNCATION)]
)
EVENT_TYPES = tuple("message reasoning tool_call tool_result compaction system_note attachment agent_spawn agent_result interruption error opaque control".split())


def utf8_prefix(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most `most` bytes."""
    raw = F.encode(text, "UTF-8")
    at = F.lit(most)
    # a byte that starts with the bits 10 continues a character: step back to where one begins, three at most
    for _ in range(3):
        byte = F.conv(F.hex(F.substring(raw, at + 1, F.lit(1))), 16, 10).cast("int")
        at = F.when(byte.bitwiseAND(F.lit(0xC0)) == 0x80, at - 1).otherwise(at)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), at), "UTF-8"))


def rendered(part: Column) -> Column:
    """What of a part enters the content fingerprint."""
    v = lambda n: F.coalesce(part[n], F.lit(""))
    join = lambda *x: F.concat_ws(":", *x)
    t = part["truncation"]
    return (
        F.when(part["type"] == "text", F.when(t.isNotNull(), join(F.lit("t"), t["full_sha256"], t["inline_bytes"].cast("string"))).otherwise(F.concat(F.lit("t:"), v("text"))))
        .when(part["type"] == "reasoning", join(F.lit("r"), F.initcap(v("visibility")), v("text")))
        .when(part["type"] == "tool_call", join(F.lit("c"), v("id"), v("name"), v("arguments_json")))
        .when(part["type"] == "tool_result", join(F.lit("o"), v("tool_call_id"), F.coalesce(part["is_error"], F.lit(False)).cast("string"), v("output_json")))
        .when(part["type"] == "image", join(F.lit("i"), v("artifact"), v("source_ref"), v("mime"), v("filename")))
        .when(part["type"] == "file_ref", join(F.lit("f"), v("path"), v("artifact"), v("mime"), v("filename")))
        .when(part["type"] == "artifact", join(F.lit("a"), v("artifact"), F.coalesce(part["size"].cast("string"), F.lit("")), v("mime"), v("filename")))
        .when(part["type"] == "data", F.concat(F.lit("d:"), v("value_json")))
        .otherwise(join(F.lit("x"), v("kind"), v("note"), v("raw_json")))
    )


def content_fingerprint(content: Column) -> Column:
    from .ids import hash_of_array

    return hash_of_array(F.transform(content, rendered))


def searchable(content: Column) -> Column:
    """The text of an event's parts, one on a line."""
    v = lambda p, n: F.coalesce(p[n], F.lit(""))
    as_text = lambda p: (
        F.when(p["type"].isin("text", "reasoning"), v(p, "text"))
        .when(p["type"] == "tool_call", F.concat_ws(" ", v(p, "name"), v(p, "arguments_json")))
        .when(p["type"] == "tool_result", v(p, "output_json"))
        .when(p["type"] == "opaque", F.concat(F.lit("["), v(p, "kind"), F.lit("] "), v(p, "note")))
        .otherwise(F.concat_ws(" ", p["filename"], p["path"]))
    )
    return F.array_join(F.filter(F.transform(content, as_text), lambda s: s != ""), "\n")
