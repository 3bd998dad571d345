"""What a parser gives for each record: an event, or that it was skipped or failed."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from ..functions.redact import canonical_json

_RFC = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(?:[.,](\d+))?(Z|z|[+-]\d\d(?::?\d\d)?)")
ROLES = {"human": "user", "user": "user", "ai": "assistant", "model": "assistant", "bot": "assistant", "assistant": "assistant", "tool_result": "tool", "function": "tool", "tool": "tool", "system": "system", "developer": "developer"}
_EPOCH = dt.datetime(1970, 1, 1)


def role_of(value: Any) -> str:
    return ROLES.get(str(value or "").strip().lower(), "other")


def _fits(ns: int) -> int | None:
    return ns if -(2**63) <= ns < 2**63 else None


def rfc3339(text: str) -> int | None:
    """Nanoseconds of a time with an explicit offset."""
    m = _RFC.fullmatch(text.strip())
    if not m:
        return None
    try:
        day = dt.datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4]), int(m[5]))
    except ValueError:
        return None
    zone = m[8].replace(":", "")
    hours, minutes = (0, 0) if zone in "Zz" else (int(zone[1:3]), int(zone[3:5] or 0))
    if int(m[6]) > 60 or hours > 23 or minutes > 59:
        return None
    offset = (hours * 3600 + minutes * 60) * (-1 if zone[0] == "-" else 1)
    seconds = (day - _EPOCH) // dt.timedelta(seconds=1) + int(m[6]) - offset
    return _fits(seconds * 10**9 + int((m[7] or "0")[:9].ljust(9, "0")))


def epoch(n: int) -> int | None:
    if n <= 0:
        return None
    return _fits(n * (10**9 if n < 10**10 else 10**6 if n < 10**13 else 1000 if n < 10**16 else 1))


def time_of(value: Any) -> tuple[int | None, str | None, str]:
    """(nanoseconds, original text, confidence) of a JSON value."""
    if value is None:
        return None, None, "unknown"
    if isinstance(value, bool):
        return None, str(value).lower(), "unknown"
    if isinstance(value, int):
        ns = epoch(value)
        return ns, str(value), "database_derived" if ns is not None else "unknown"
    if isinstance(value, float):
        micros = round(value * (1e6 if value < 1e11 else 1e3))
        ns = _fits(micros * 1000) if value > 0 else None
        return ns, repr(value), "provider_derived" if ns is not None else "unknown"
    text = str(value)
    ns = rfc3339(text)
    if ns is not None:
        return ns, text, "exact"
    ns = epoch(int(text)) if re.fullmatch(r"\d{1,19}", text.strip()) else None
    return ns, text, "database_derived" if ns is not None else "unknown"


# parts


def text(value: str) -> dict:
    return {"type": "text", "text": value}


def reasoning(value: str, visibility: str = "public") -> dict:
    return {"type": "reasoning", "text": value, "visibility": visibility}


def call(id_: Any, name: Any, arguments: Any) -> dict:
    return {"type": "tool_call", "id": None if id_ is None else str(id_), "name": str(name or ""), "arguments_json": canonical_json(arguments)}


def result(id_: Any, output: Any, is_error: bool = False) -> dict:
    return {"type": "tool_result", "tool_call_id": None if id_ is None else str(id_), "output_json": canonical_json(output), "is_error": bool(is_error)}


def file_ref(path: Any = None, filename: Any = None, mime: Any = None) -> dict:
    return {"type": "file_ref", "path": path, "filename": filename, "mime": mime}


def image(source_ref: Any = None, mime: Any = None, filename: Any = None) -> dict:
    return {"type": "image", "source_ref": source_ref, "mime": mime, "filename": filename}


def data(value: Any) -> dict:
    return {"type": "data", "value_json": canonical_json(value)}


def opaque(kind: Any, raw: Any = None, note: str | None = None) -> dict:
    return {"type": "opaque", "kind": str(kind or "unknown"), "note": note, "raw_json": canonical_json(raw)}


def kind_of(parts: list[dict], default: str = "message") -> str:
    """tool_call without a text but with a call, reasoning where there is nothing else, tool_result likewise."""
    kinds = [p["type"] for p in parts]
    if "text" in kinds or not kinds:
        return default
    if "tool_call" in kinds:
        return "tool_call"
    if all(k == "reasoning" for k in kinds):
        return "reasoning"
    return "tool_result" if all(k == "tool_result" for k in kinds) else default


def event(ord_: int, role: str, kind: str, content: list[dict], *, native_id: Any = None, parent: Any = None, time: Any = None, conversation: Any = None, session: Any = None, **more: Any) -> dict:
    ns, original, confidence = time_of(time)
    known = {k: more.pop(k) for k in ("title", "model", "agent", "cwd", "branch") if k in more}
    return {
        "outcome": "event",
        "record": ord_,
        "role": role,
        "event_type": kind,
        "content": content,
        "native_id": None if native_id is None else str(native_id),
        "parent_native_id": None if parent is None else str(parent),
        "ts_ns": ns,
        "timestamp_original": original,
        "timestamp_confidence": confidence,
        "conversation_native": None if conversation is None else str(conversation),
        "session_native": None if session is None else str(session),
        **known,
        "metadata": canonical_json({k: v for k, v in more.items() if v is not None}),
    }


def skipped(ord_: int, why: str) -> dict:
    return {"outcome": "skipped", "record": ord_, "error": why}


def failed(ord_: int, why: str) -> dict:
    return {"outcome": "failed", "record": ord_, "error": why}
