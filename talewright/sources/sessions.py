"""Parsers of line-oriented session files. Each record is one event, one skip or one failure."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import Any

from . import drafts as D
from .lines import objects

UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)


def _text_of(value: Any) -> str | None:
    return value if isinstance(value, str) else None


def _blocks(content: Any, convert: Any) -> list[dict]:
    if isinstance(content, str):
        return [D.text(content)]
    return [convert(b) if isinstance(b, dict) else D.opaque("block", b) for b in content or []] if isinstance(content, list) else []


# claude_code

_NOISE = set("mode progress cost-state atis-latch last-prompt permission-mode queue-operation bridge-session file-history-delta file-history-snapshot".split())


def _claude_block(b: dict) -> dict:
    kind = b.get("type")
    if kind == "text":
        return D.text(str(b.get("text", "")))
    if kind == "thinking":
        return D.reasoning(str(b.get("thinking") or ""), "public" if b.get("thinking") else "opaque")
    if kind == "redacted_thinking":
        return D.reasoning("", "opaque")
    if kind == "tool_use":
        return D.call(b.get("id"), b.get("name"), b.get("input"))
    if kind == "tool_result":
        return D.result(b.get("tool_use_id"), b.get("content"), bool(b.get("is_error")))
    if kind == "image":
        source = b.get("source") or {}
        return D.image(source.get("url"), source.get("media_type"))
    return D.opaque(kind, b)


def claude_code(path: str, raw: bytes) -> Iterator[dict]:
    """The header is the first known session, directory and branch; a sidechain is a conversation of its own."""
    records = list(objects(raw))
    first = lambda key: next((v[key] for _, v, _ in records if v and v.get(key) is not None), None)
    session, cwd, branch = first("sessionId"), first("cwd"), first("gitBranch")
    title = next((v.get("title") or v.get("customTitle") or v.get("aiTitle") or v.get("summary") for _, v, _ in records if v and v.get("type") in ("summary", "ai-title", "custom-title")), None)
    for n, v, error in records:
        if error:
            yield D.failed(n, error)
            continue
        kind = v.get("type")
        if not isinstance(kind, str):
            yield D.failed(n, "no type")
            continue
        if kind in _NOISE:
            yield D.skipped(n, kind)
            continue
        side = bool(v.get("isSidechain"))
        own = v.get("sessionId") or session
        base = {"native_id": v.get("uuid"), "parent": v.get("parentUuid"), "time": v.get("timestamp"), "session": own, "conversation": f"{own}/agent-{v['agentId']}" if side and v.get("agentId") else own, "cwd": v.get("cwd") or cwd, "branch": v.get("gitBranch") or branch, "title": title, "agent": v.get("agentId"), "is_sidechain": side or None, "parent_session_id": own if side else None, "is_meta": v.get("isMeta")}
        message = v.get("message")
        if kind in ("user", "assistant"):
            if not isinstance(message, dict):
                yield D.failed(n, "no message")
                continue
            parts = _blocks(message.get("content"), _claude_block)
            role = D.role_of(message.get("role") or kind)
            if role == "user" and parts and all(p["type"] == "tool_result" for p in parts):
                role = "tool"
            what = "compaction" if v.get("isCompactSummary") else D.kind_of(parts)
            calls = [p["id"] for p in parts if p["type"] == "tool_call"]
            yield D.event(n, role, what, parts, model=message.get("model") if role == "assistant" else None, usage=message.get("usage"), stop_reason=message.get("stop_reason"), request_id=v.get("requestId"), tool_call_ids=calls or None, **base)
        elif kind == "system":
            what = "compaction" if v.get("subtype") == "compact_boundary" else "system_note"
            yield D.event(n, "system", what, [D.text(v["content"])] if isinstance(v.get("content"), str) else [D.data(v)], subtype=v.get("subtype"), **base)
        elif kind in ("summary", "ai-title", "custom-title"):
            said = v.get("summary") or v.get("aiTitle") or v.get("customTitle") or v.get("title") or ""
            yield D.event(n, "system", "system_note", [D.text(str(said))], record_type=kind, leaf=v.get("leafUuid"), **base)
        elif kind == "attachment":
            yield D.event(n, "user", "attachment", [D.data(v.get("attachment"))], **base)
        else:
            yield D.event(n, "other", "opaque", [D.opaque(kind, v)], **base)


# codex


def _codex_block(b: dict) -> dict:
    if b.get("type") in ("input_text", "output_text", "text", "summary_text", "reasoning_text"):
        return D.text(str(b.get("text", "")))
    if b.get("type") == "input_image":
        return D.image(b.get("image_url"))
    return D.opaque(b.get("type"), b)


def _arguments(value: Any) -> Any:
    import json

    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def codex(path: str, raw: bytes) -> Iterator[dict]:
    """turn_context sets the model and directory of what follows; echoes of items are skipped."""
    model = cwd = branch = session = parent = None
    subagent = None
    for n, v, error in objects(raw):
        if error:
            yield D.failed(n, error)
            continue
        kind, item, time = v.get("type"), v.get("payload"), v.get("timestamp")
        legacy = not isinstance(item, dict)
        if legacy and kind is None and "id" in v and session is None:
            session = v["id"]
            text = v.get("instructions")
            yield D.event(n, "system", "system_note", [D.text(text)] if isinstance(text, str) else [D.data(v)], native_id=f"{session}:session_meta", time=time, conversation=session, session=session)
            continue
        if legacy:
            if kind is None:
                yield D.skipped(n, "state") if v.get("record_type") == "state" else D.failed(n, "no type")
                continue
            item, kind, time = v, "response_item", v.get("timestamp")
        base = lambda: {"time": time, "conversation": session, "session": session, "cwd": cwd, "branch": branch, "is_subagent": subagent, "parent_session_id": parent}  # noqa: B023, E731
        if kind == "session_meta":
            if session is not None and item.get("id") != session:
                yield D.skipped(n, "header of a copied session")
                continue
            session, cwd = item.get("id"), item.get("cwd") or cwd
            branch = (item.get("git") or {}).get("branch")
            spawn = ((item.get("source") or {}).get("subagent") or {}).get("thread_spawn") if isinstance(item.get("source"), dict) else None
            subagent, parent = (True, (spawn or {}).get("parent_thread_id")) if isinstance(item.get("source"), dict) and "subagent" in item["source"] else (None, item.get("forked_from_id"))
            text = (item.get("base_instructions") or {}).get("text") if isinstance(item.get("base_instructions"), dict) else None
            yield D.event(n, "system", "system_note", [D.text(text)] if text else [D.data(item)], native_id=f"{session}:session_meta", **base())
        elif kind == "turn_context":
            model, cwd = item.get("model") or model, item.get("cwd") or cwd
            yield D.skipped(n, kind)
        elif kind == "response_item":
            what = item.get("type")
            if what == "message":
                role = D.role_of(item.get("role"))
                yield D.event(n, role, "message", _blocks(item.get("content"), _codex_block), native_id=item.get("id"), model=model if role == "assistant" else None, **base())
            elif what == "reasoning":
                shown = [b.get("text", "") for b in item.get("content") or [] if isinstance(b, dict)]
                parts = [D.reasoning(t, "public") for t in shown] or [D.reasoning(b.get("text", ""), "summary") for b in item.get("summary") or [] if isinstance(b, dict)]
                yield D.event(n, "assistant", "reasoning", parts or [D.reasoning("", "opaque")], native_id=item.get("id"), model=model, **base())
            elif isinstance(what, str) and what.endswith("_output"):
                output = item.get("output")
                yield D.event(n, "tool", "tool_result", [D.result(item.get("call_id"), _arguments(output), isinstance(output, dict) and output.get("success") is False)], native_id=f"{item['call_id']}:output" if item.get("call_id") else None, **base())
            elif isinstance(what, str) and what.endswith("_call"):
                ident = item.get("call_id") or item.get("id")
                arguments = item.get("arguments", item.get("input", item.get("action")))
                yield D.event(n, "assistant", "tool_call", [D.call(ident, item.get("name") or what, _arguments(arguments))], native_id=f"{ident}:call" if ident else None, model=model, **base())
            elif what is None:
                yield D.failed(n, "an item without a type")
            else:
                yield D.event(n, "other", "opaque", [D.opaque(what, item)], model=model, **base())
        elif kind == "compacted":
            yield D.event(n, "system", "compaction", [D.text(str(item.get("message", "")))], native_id=f"compacted:{item['id']}" if item.get("id") else None, **base())
        elif kind == "event_msg":
            what = item.get("type")
            if what == "turn_aborted":
                yield D.event(n, "system", "interruption", [D.text(str(item.get("reason", "")))], **base())
            elif what in ("error", "stream_error"):
                yield D.event(n, "system", "error", [D.text(str(item.get("message", "")))], **base())
            else:
                yield D.skipped(n, f"echo {what}")
        elif kind == "token_usage_record":
            yield D.skipped(n, kind)
        elif isinstance(kind, str):
            yield D.event(n, "other", "opaque", [D.opaque(kind, item)], **base())
        else:
            yield D.failed(n, "no type")


# pi and its forks


def _pi_block(b: dict) -> dict:
    kind = b.get("type")
    if kind == "text":
        return D.text(str(b.get("text", "")))
    if kind == "thinking":
        return D.reasoning(str(b.get("thinking") or ""), "public" if b.get("thinking") else "opaque")
    if kind == "toolCall":
        return D.call(b.get("id"), b.get("name"), b.get("arguments"))
    if kind == "image":
        return D.image(None, b.get("mimeType"))
    return D.opaque(kind, b)


def _pi_message(n: int, m: dict, base: dict) -> dict:
    role, content = m.get("role"), m.get("content")
    if role == "toolResult":
        return D.event(n, "tool", "tool_result", [D.result(m.get("toolCallId"), content, bool(m.get("isError")))], tool_name=m.get("toolName"), **base)
    if role == "bashExecution":
        parts = [D.call(None, "bash", {"command": m.get("command")}), D.result(None, {"output": m.get("output"), "exitCode": m.get("exitCode")}, bool(m.get("exitCode")))]
        return D.event(n, "user", "tool_call", parts, **base)
    parts = _blocks(content, _pi_block)
    who = D.role_of(role)
    return D.event(n, who, D.kind_of(parts), parts, model=m.get("model") if who == "assistant" else None, usage=m.get("usage"), stop_reason=m.get("stopReason"), **base)


def pi(path: str, raw: bytes) -> Iterator[dict]:
    session = cwd = title = None
    for n, v, error in objects(raw):
        if error:
            yield D.failed(n, error)
            continue
        kind = v.get("type")
        if kind == "title":
            title = (v.get("title") or "").strip() or title
            yield D.skipped(n, kind)
            continue
        if kind == "session":
            session, cwd = v.get("id"), v.get("cwd")
            yield D.event(n, "system", "system_note", [D.data(v)], native_id=f"{session}:session", time=v.get("timestamp"), conversation=session, session=session, cwd=cwd, title=title, parent_session_id=v.get("parentSession"))
            continue
        if not isinstance(kind, str):
            yield D.failed(n, "no type")
            continue
        message = v.get("message")
        base = {"native_id": v.get("id"), "parent": v.get("parentId"), "time": v.get("timestamp"), "conversation": session, "session": session, "cwd": cwd, "title": title}
        if kind == "message":
            if not isinstance(message, dict):
                yield D.failed(n, "no message")
                continue
            yield _pi_message(n, message, base)
        elif kind in ("compaction", "branch_summary"):
            yield D.event(n, "system", "compaction", [D.text(str(v.get("summary", "")))], **base)
        elif kind == "custom_message":
            yield D.event(n, "system", "system_note", _blocks(v.get("content"), _pi_block) or [D.data(v)], **base)
        elif kind in ("model_change", "thinking_level_change", "label", "session_info", "custom"):
            yield D.event(n, "system", "control", [D.data(v)], **base)
        else:
            yield D.event(n, "other", "opaque", [D.opaque(kind, v)], **base)


def minimax(path: str, raw: bytes) -> Iterator[dict]:
    """The session's id is the base64 name of its folder; the live file and snapshots are one conversation."""
    folder = next((p for p in reversed(path.replace("\\", "/").split("/")[:-1]) if p != "snapshots"), "")
    try:
        session = base64.urlsafe_b64decode(folder + "=" * (-len(folder) % 4)).decode()
    except (ValueError, UnicodeDecodeError):
        session = folder
    for n, v, error in objects(raw):
        message = (v or {}).get("message", v)
        if error or not isinstance(message, dict) or "role" not in message:
            yield D.failed(n, error or "no message")
            continue
        yield _pi_message(n, message, {"native_id": v.get("id"), "parent": v.get("parentId"), "time": v.get("timestamp") or message.get("timestamp"), "conversation": session, "session": session})


# gemini_cli


def gemini_cli(path: str, raw: bytes) -> Iterator[dict]:
    """The last write of a message id wins and stands at its first place; $set patches the header."""
    header: dict = {}
    order: dict[str, tuple[int, dict]] = {}
    bad: list[dict] = []
    if raw.lstrip()[:1] == b"{" and b'"messages"' in raw[:4096]:
        import json

        try:
            whole = json.loads(raw)
            header = {k: v for k, v in whole.items() if k != "messages"}
            for n, m in enumerate(whole["messages"]):
                order[str(m.get("id", n))] = (n, m)
        except (ValueError, TypeError, KeyError, AttributeError):
            order = {}
    if not order:
        for n, v, error in objects(raw):
            if error:
                bad.append(D.failed(n, error))
            elif "$set" in v:
                header |= v["$set"] if isinstance(v["$set"], dict) else {}
                bad.append(D.skipped(n, "$set"))
            elif "sessionId" in v and "type" not in v:
                header |= v
                bad.append(D.skipped(n, "header"))
            elif v.get("id") is not None:
                key = str(v["id"])
                if key in order:
                    bad.append(D.skipped(n, "replaced"))
                order[key] = (order[key][0] if key in order else n, v)
            else:
                bad.append(D.failed(n, "no id"))
    session = header.get("sessionId")
    for n, m in sorted(order.values(), key=lambda x: x[0]):
        role = {"user": "user", "gemini": "assistant"}.get(m.get("type"), D.role_of(m.get("type")))
        parts = [D.reasoning(str(t.get("description") or t.get("subject") or ""), "summary") for t in m.get("thoughts") or [] if isinstance(t, dict)]
        parts += _blocks(m.get("content"), lambda b: D.text(str(b["text"])) if "text" in b else D.opaque("block", b))
        calls = [c for c in m.get("toolCalls") or [] if isinstance(c, dict)]
        parts += [D.call(c.get("id"), c.get("name"), c.get("args")) for c in calls]
        base = {"time": m.get("timestamp"), "conversation": session, "session": session}
        yield D.event(n, role, D.kind_of(parts), parts, native_id=m.get("id"), model=m.get("model"), **base)
        for c in calls:
            if "result" in c:
                yield D.event(n, "tool", "tool_result", [D.result(c.get("id"), c["result"], c.get("status") == "error")], native_id=f"{m.get('id')}/{c.get('id')}", parent=m.get("id"), **base)
    yield from bad


# antigravity, deepseek


def antigravity(path: str, raw: bytes) -> Iterator[dict]:
    found = re.search(rf"brain/({UUID.pattern})", path.replace("\\", "/"), re.I)
    conversation = found[1] if found else None
    for n, v, error in objects(raw):
        if error or "type" not in v:
            yield D.failed(n, error or "no type")
            continue
        kind, source = str(v["type"]).upper(), str(v.get("source", "")).upper()
        base = {"time": v.get("created_at") or v.get("timestamp"), "conversation": conversation, "step_index": v.get("step_index")}
        content = v.get("content")
        parts = [D.text(content)] if isinstance(content, str) and content else []
        if v.get("thinking"):
            parts.insert(0, D.reasoning(str(v["thinking"])))
        parts += [D.call(c.get("id"), c.get("name"), c.get("args", c.get("arguments"))) for c in v.get("tool_calls") or [] if isinstance(c, dict)]
        if "USER" in source or kind == "USER_INPUT":
            yield D.event(n, "user", "message", parts or [D.data(v)], **base)
        elif kind in ("PLANNER_RESPONSE", "MODEL_RESPONSE", "NOTIFY_USER"):
            yield D.event(n, "assistant", D.kind_of(parts), parts or [D.data(v)], **base)
        elif kind == "ERROR_MESSAGE":
            yield D.event(n, "system", "error", parts or [D.data(v)], **base)
        elif source == "MODEL":
            yield D.event(n, "tool", "tool_result", [D.result(None, content if content is not None else v)], tool=kind.lower(), **base)
        else:
            yield D.event(n, "system", "system_note", parts or [D.opaque(kind, v)], **base)


_TELEMETRY = re.compile(r"(telemetry|heartbeat|metric|usage|progress|status|state|ui_|ping|checkpoint)", re.I)


def deepseek(path: str, raw: bytes) -> Iterator[dict]:
    session = cwd = None
    for n, v, error in objects(raw):
        if error:
            yield D.failed(n, error)
            continue
        kind = v.get("type") or v.get("kind")
        if n == 1 and ("session_id" in v or "sessionId" in v or kind == "session"):
            session, cwd = v.get("session_id") or v.get("sessionId") or v.get("id"), v.get("cwd")
            yield D.skipped(n, "header")
            continue
        message = v.get("message") if isinstance(v.get("message"), dict) else v
        if "role" not in message:
            yield D.skipped(n, str(kind)) if kind and _TELEMETRY.search(str(kind)) else D.event(n, "other", "opaque", [D.opaque(kind, v)], native_id=f"seq-{v['seq']}" if "seq" in v else None, time=v.get("timestamp"), conversation=session, session=session)
            continue
        parts = ([D.reasoning(str(message["reasoning_content"]))] if message.get("reasoning_content") else []) + _blocks(message.get("content"), _claude_block)
        parts += [D.call(c.get("id"), (c.get("function") or c).get("name"), _arguments((c.get("function") or c).get("arguments"))) for c in message.get("tool_calls") or [] if isinstance(c, dict)]
        role = D.role_of(message["role"])
        if role == "tool":
            parts = [D.result(message.get("tool_call_id"), message.get("content"))]
        yield D.event(n, role, "tool_result" if role == "tool" else D.kind_of(parts), parts, native_id=message.get("id") or v.get("id") or (f"seq-{v['seq']}" if "seq" in v else None), time=v.get("timestamp") or message.get("timestamp"), conversation=session, session=session, cwd=cwd, model=message.get("model"))


# generic


def _generic(n: int, v: Any, path: str) -> dict:
    if not isinstance(v, dict):
        return D.failed(n, "not an object")
    content = v.get("content", v.get("text"))
    if not isinstance(v.get("role"), str) or not isinstance(content, str):
        return D.skipped(n, "no role or text")
    return D.event(n, D.role_of(v["role"]), "message", [D.text(content)], native_id=v.get("id"), time=next((v[k] for k in ("timestamp", "created_at", "time") if v.get(k) is not None), None))


def generic_jsonl(path: str, raw: bytes) -> Iterator[dict]:
    for n, v, error in objects(raw):
        yield D.failed(n, error) if error else _generic(n, v, path)


def generic_json(path: str, raw: bytes) -> Iterator[dict]:
    """An array, one object (perhaps with messages in it), or lines after all."""
    import json

    from .lines import elements

    start = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
    if start == b"[":
        for n, v, error in elements(raw):
            yield D.failed(n, error) if error else _generic(n, v, path)
        return
    try:
        v = json.loads(raw)
    except ValueError:
        yield from generic_jsonl(path, raw)
        return
    listed = v.get("messages") if isinstance(v, dict) and isinstance(v.get("messages"), list) else [v]
    for n, m in enumerate(listed):
        yield _generic(n, m, path)
