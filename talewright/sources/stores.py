"""Parsers of stores: SQLite databases and bundles of several tables."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator
from typing import Any

from . import drafts as D
from .lines import objects
from .sessions import _arguments, _claude_block

MAX_CELL = 64 << 20


class Database:
    """A database opened from its bytes: in memory, or with those of its write-ahead log on a private copy."""

    def __init__(self, data: bytes, wal: bytes | None = None):
        self.folder = None
        if not wal and data[18:20] == b"\x01\x01":  # written without such a log
            self.con = sqlite3.connect(":memory:")
            self.con.deserialize(data)
            self.con.row_factory = sqlite3.Row
            return
        self.folder = tempfile.TemporaryDirectory()
        path = os.path.join(self.folder.name, "db")
        with open(path, "wb") as f:
            f.write(data)
        if wal:
            with open(path + "-wal", "wb") as f:
                f.write(wal)
        self.con = sqlite3.connect(path)
        self.con.row_factory = sqlite3.Row

    def tables(self) -> set[str]:
        return {r[0] for r in self.con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}

    def rows(self, sql: str, most: int = MAX_CELL) -> Iterator[dict]:
        """Rows as objects; a text over `most` bytes becomes null with <column>__oversize, a blob null."""
        for r in self.con.execute(sql):
            out: dict[str, Any] = {}
            for k in r.keys():
                v = r[k]
                if isinstance(v, bytes):
                    v = None
                elif isinstance(v, str) and len(v.encode("utf-8", "replace")) > most:
                    out[f"{k}__oversize"], v = len(v), None
                out[k] = v
            yield out

    def close(self) -> None:
        self.con.close()
        if self.folder:
            self.folder.cleanup()


# opencode


def _opencode_message(n: int, session: dict, info: dict, parts: list[dict]) -> Iterator[dict]:
    """A message with its parts; every finished tool part gives a tool_result event too."""
    content: list[dict] = []
    results: list[tuple[dict, dict]] = []
    unfinished = []
    for p in parts:
        kind = p.get("type")
        if kind == "text":
            content.append(D.text(str(p.get("text", ""))))
        elif kind == "reasoning":
            content.append(D.reasoning(str(p.get("text", ""))))
        elif kind == "tool":
            state = p.get("state") or {}
            content.append(D.call(p.get("callID"), p.get("tool"), state.get("input")))
            if state.get("status") in ("completed", "error"):
                results.append((p, D.result(p.get("callID"), state.get("output", state.get("error")), state["status"] == "error")))
            else:
                unfinished.append(p.get("callID"))
        elif kind == "file":
            content.append(D.file_ref(p.get("url"), p.get("filename"), p.get("mime")))
        elif kind == "compaction":
            content.append(D.opaque(kind, p))
        elif kind in ("step-start", "step-finish", "snapshot", "patch"):
            continue
        else:
            content.append(D.opaque(kind, p))
    role = D.role_of(info.get("role"))
    model = info.get("modelID") or (info["model"].get("modelID") if isinstance(info.get("model"), dict) else info.get("model"))
    base = {"conversation": session.get("id") or info.get("sessionID"), "session": session.get("id") or info.get("sessionID"), "title": session.get("title"), "cwd": session.get("directory"), "agent": info.get("agent")}
    created = (info.get("time") or {}).get("created") if isinstance(info.get("time"), dict) else info.get("time_created")
    kind = "compaction" if any(p.get("kind") == "compaction" for p in content) else D.kind_of(content)
    yield D.event(n, role, kind, content, native_id=info.get("id"), parent=info.get("parentID"), time=created, model=model if role == "assistant" else None, unfinished_tool_calls=unfinished or None, **base)
    for p, r in results:
        ended = ((p.get("state") or {}).get("time") or {}).get("end")
        yield D.event(n, "tool", "tool_result", [r], native_id=f"{p.get('id')}:result", parent=info.get("id"), time=ended, **base)


def opencode(path: str, raw: bytes) -> Iterator[dict]:
    """A database (session, message and part joined on their ids) or an export bundle."""
    if raw[:16].startswith(b"SQLite format 3"):
        db = Database(raw)
        try:
            session = {r["id"]: r for r in db.rows("SELECT * FROM session")}
            parts: dict[str, list[dict]] = {}
            n = 0
            for r in db.rows("SELECT id, message_id, data FROM part ORDER BY message_id, time_created, id"):
                try:
                    parts.setdefault(r["message_id"], []).append({"id": r["id"], **json.loads(r["data"])})
                except (ValueError, TypeError) as e:
                    yield D.failed(n, f"part: {e}")
                    n += 1
            for r in db.rows("SELECT id, session_id, time_created, data FROM message ORDER BY session_id, time_created, id"):
                try:
                    info = {"id": r["id"], "sessionID": r["session_id"], "time_created": r["time_created"], **json.loads(r["data"])}
                except (ValueError, TypeError) as e:
                    yield D.failed(n, f"message: {e}")
                    n += 1
                    continue
                yield from _opencode_message(n, session.get(r["session_id"], {"id": r["session_id"]}), info, parts.get(r["id"], []))
                n += 1
        finally:
            db.close()
        return
    try:
        bundle = json.loads(raw)
        listed, about = bundle["messages"], bundle.get("info") or {}
    except (ValueError, KeyError, TypeError) as e:
        yield D.failed(0, f"no bundle: {e}")
        return
    for n, m in enumerate(listed):
        if not isinstance(m, dict) or not isinstance(m.get("info"), dict) or "role" not in m["info"]:
            yield D.failed(n, "a message without its head")
            continue
        yield from _opencode_message(n, about, m["info"], [p for p in m.get("parts") or [] if isinstance(p, dict)])


# hermes


def _tool_error(output: Any) -> bool:
    return isinstance(output, dict) and bool(output.get("error") or output.get("exit_code"))


def _hermes_message(n: int, m: dict, session: str | None, **base: Any) -> dict:
    role = D.role_of(m.get("role"))
    own = f"hermes-session-{session}" if session else None
    parts = ([D.reasoning(str(m["reasoning"]))] if m.get("reasoning") else []) + ([D.text(m["content"])] if isinstance(m.get("content"), str) and m["content"] else [_claude_block(b) for b in m.get("content") or [] if isinstance(b, dict)])
    calls = _arguments(m.get("tool_calls")) or []
    parts += [D.call(c.get("id"), (c.get("function") or c).get("name"), _arguments((c.get("function") or c).get("arguments"))) for c in calls if isinstance(c, dict)]
    kind = D.kind_of(parts)
    if role == "tool":
        output = _arguments(m.get("content"))
        parts, kind = [D.result(m.get("tool_call_id"), output, _tool_error(output))], "tool_result"
    if m.get("_compressed_summary") or m.get("compacted"):
        kind = "compaction"
    native = f"{own}:{m['id']}" if own and m.get("id") is not None else None
    inactive = m.get("active") == 0 or None
    return D.event(n, role, kind, parts, native_id=native, time=m.get("timestamp"), conversation=own, session=own, tool_name=m.get("tool_name"), finish_reason=m.get("finish_reason"), inactive=inactive, **base)


def hermes(path: str, raw: bytes) -> Iterator[dict]:
    """The state database, one session's JSON, or a transcript of lines."""
    if raw[:16].startswith(b"SQLite format 3"):
        db = Database(raw)
        try:
            n = 0
            messages: dict[str, list[dict]] = {}
            for m in db.rows("SELECT * FROM messages ORDER BY session_id, id"):
                messages.setdefault(m["session_id"], []).append(m)
            for s in db.rows("SELECT * FROM sessions ORDER BY started_at, id"):
                base = {"title": s.get("title"), "cwd": s.get("cwd"), "model": s.get("model"), "source": s.get("source")}
                own = f"hermes-session-{s['id']}"
                if s.get("system_prompt"):
                    yield D.event(n, "system", "system_note", [D.text(s["system_prompt"])], native_id=f"{own}:system", time=s.get("started_at"), conversation=own, session=own, **base)
                    n += 1
                for m in messages.get(s["id"], []):
                    yield _hermes_message(n, m, s["id"], **base)
                    n += 1
        finally:
            db.close()
        return
    if raw.lstrip()[:1] == b"{" and b"\n{" not in raw.strip():
        try:
            s = json.loads(raw)
        except ValueError as e:
            yield D.failed(0, f"invalid JSON: {e}")
            return
        base = {"model": s.get("model"), "platform": s.get("platform")}
        own = f"hermes-session-{s.get('session_id')}"
        n = 0
        if s.get("system_prompt"):
            yield D.event(n, "system", "system_note", [D.text(s["system_prompt"])], native_id=f"{own}:system", time=s.get("session_start"), conversation=own, session=own, **base)
            n = 1
        for m in s.get("messages") or []:
            yield _hermes_message(n, m, s.get("session_id"), **base)
            n += 1
        return
    session = None
    name = path.replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".jsonl")
    for n, v, error in objects(raw):
        if error:
            yield D.failed(n, error)
        elif v.get("role") == "session_meta" or v.get("type") == "session_meta":
            session = v.get("session_id") or name
            yield D.skipped(n, "session_meta")
        elif "role" in v:
            yield _hermes_message(n, v, session or name)
        else:
            yield D.failed(n, "no role")
