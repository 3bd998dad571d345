"""Deterministic ids: length-prefixed BLAKE3 over text parts, and the identity rules built on it."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blake3 import digests

HEX = 24


def framed(parts: Iterable[str | None]) -> bytes:
    """Each part with its byte length before and a unit separator behind."""
    raw = [(p or "").encode() for p in parts]
    return b"".join(struct.pack("<Q", len(p)) + p + b"\x1f" for p in raw)


def hash_parts(*parts: str | None) -> str:
    return digests([framed(parts)])[0].hex()


def make_id(prefix: str, *parts: str | None) -> str:
    return prefix + hash_parts(*parts)[:HEX]


@F.pandas_udf(StringType())
def _hash_arrays(parts: pd.Series) -> pd.Series:
    return pd.Series([d.hex() for d in digests([framed(p if p is not None else ()) for p in parts])], index=parts.index)


def hash_of(*parts: Column | str) -> Column:
    """Hex digest of the parts; a null part counts as empty."""
    return _hash_arrays(F.array(*[F.coalesce(F.lit(p) if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]))


def hash_of_array(parts: Column) -> Column:
    return _hash_arrays(parts)


def id_of(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(hash_of(*parts), 1, HEX))


def is_globally_unique(native: Column) -> Column:
    """Whether a provider's id can stand for a record anywhere: a UUID, long hex, or long and mixed."""
    s = F.trim(native)
    chunks = F.split(s, "-")
    uuid = s.rlike("^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")
    long_hex = (F.size(chunks) != 5) & F.exists(chunks, lambda c: c.rlike("^[0-9A-Fa-f]{32,}$"))
    distinct = F.size(F.array_distinct(F.filter(F.split(s, ""), lambda c: c.rlike(r"^[\x00-\x7F]$"))))
    mixed = (F.octet_length(s) >= 20) & s.rlike("[A-Za-z]") & s.rlike("[0-9]") & (distinct >= 12)
    return F.coalesce((F.octet_length(s) >= 16) & (uuid | long_hex | mixed), F.lit(False))


def conversation_key(provider: Column, application: Column, native: Column, session: Column, fallback: list[Column]) -> Column:
    """Id of a conversation: by its own id or its session's where they are unique, else by coordinates.

    A conversation that has an id which isn't unique gets no fallback parts, so all of those of one application
    share a key; only conversations without any id are told apart by them.
    """
    unique = F.when(is_globally_unique(native), native).when(is_globally_unique(session), session)
    none = F.array(provider, application, F.lit("coord"))
    parts = F.when(unique.isNotNull(), F.array(provider, application, F.lit("native"), unique)).when(native.isNotNull(), none)
    return F.concat(F.lit("cv_"), F.substring(hash_of_array(parts.otherwise(F.concat(none, F.array(*[F.coalesce(f, F.lit("")) for f in fallback])))), 1, HEX))


def event_identity(provider: Column, application: Column, conversation: Column, native: Column, seq: Column, role: Column, kind: Column, content_fp: Column) -> tuple[Column, Column]:
    """(event id, tier) by the best evidence: a unique id, an id within the conversation, the content."""
    has = native.isNotNull() & (native != "")
    tier = F.when(is_globally_unique(native), "native").when(has, "coordinates").otherwise("fingerprint")
    parts = (
        F.when(tier == "native", F.array(provider, application, F.lit("native"), native))
        .when(tier == "coordinates", F.array(provider, application, F.lit("coord"), conversation, native))
        .otherwise(F.array(provider, application, F.lit("fp"), conversation, seq.cast("string"), role, kind, content_fp))
    )
    return F.concat(F.lit("ev_"), F.substring(hash_of_array(parts), 1, HEX)), tier


def variant_id(event_id: Column, content_fp: Column) -> Column:
    return id_of("ev_", "variant", event_id, content_fp)


def session_id(provider: Column, application: Column, native: Column) -> Column:
    return F.when(native.isNotNull(), id_of("se_", provider, application, native))


def machine_id(key: str, platform: str) -> str:
    """Id of the machine that a key (host name, say) stands for, whatever its case and surrounding blanks."""
    return f"{platform}/{hash_parts('talewright.machine', key.strip().lower())[:HEX]}"
