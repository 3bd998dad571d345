"""Parsers of web exports: whole-file JSON and HTML."""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import Any

from . import drafts as D
from .lines import elements


def _listed(raw: bytes) -> Iterator[tuple[int, Any, str | None]]:
    if raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"[":
        yield from elements(raw)
        return
    try:
        yield 0, json.loads(raw), None
    except ValueError as e:
        yield 0, None, f"invalid JSON: {e}"


# chatgpt_export


def chatgpt(path: str, raw: bytes) -> Iterator[dict]:
    """All nodes with a message, by time (those without last); the parent is the nearest ancestor with a message."""
    n = 0
    for _, c, error in _listed(raw):
        if error or not isinstance(c, dict) or not isinstance(c.get("mapping"), dict):
            yield D.failed(n, error or "no mapping")
            n += 1
            continue
        nodes = c["mapping"]
        current, seen = set(), c.get("current_node")
        while seen in nodes and seen not in current:
            current.add(seen)
            seen = nodes[seen].get("parent")

        def above(key: str) -> str | None:
            up, walked = nodes[key].get("parent"), set()  # noqa: B023
            while up in nodes and up not in walked:  # noqa: B023
                if isinstance(nodes[up].get("message"), dict):  # noqa: B023
                    return up
                walked.add(up)
                up = nodes[up].get("parent")  # noqa: B023
            return None

        stamp = lambda k: (nodes[k].get("message") or {}).get("create_time")  # noqa: B023, E731
        for key in sorted(nodes, key=lambda k: stamp(k) if isinstance(stamp(k), (int, float)) else math.inf):
            m = nodes[key].get("message")
            if not isinstance(m, dict):
                yield D.skipped(n, "a node without a message")
                n += 1
                continue
            content = m.get("content") or {}
            parts = []
            if isinstance(content, dict):
                parts += [D.text(p) if isinstance(p, str) else D.opaque((p or {}).get("content_type") if isinstance(p, dict) else "part", p) for p in content.get("parts") or []]
                if isinstance(content.get("text"), str):
                    parts.append(D.text(content["text"]))
            about = m.get("metadata") or {}
            for a in [*(m.get("attachments") or []), *(about.get("attachments") or [])]:
                if isinstance(a, dict):
                    parts.append(D.file_ref(a.get("id"), a.get("name"), a.get("mime_type")))
            time = m.get("create_time")
            role = D.role_of((m.get("author") or {}).get("role"))
            yield D.event(
                n, role, "message", parts, native_id=key, parent=above(key), time=float(time) if isinstance(time, (int, float)) else time, conversation=c.get("conversation_id") or c.get("id"), title=c.get("title"),
                model=about.get("model_slug") or (c.get("default_model_slug") if role == "assistant" else None), current_path=key in current, message_id=m.get("id"), status=m.get("status"), recipient=m.get("recipient"),
            )
            n += 1


# claude_web_export, claude_design_export

_ZERO = "00000000-0000-4000-8000-000000000000"


def _web_block(b: Any) -> dict:
    if not isinstance(b, dict):
        return D.opaque("block", b)
    kind = b.get("type")
    if kind == "text":
        return D.text(str(b.get("text", "")))
    if kind == "thinking":
        return D.reasoning(str(b.get("thinking") or ""))
    if kind == "tool_use":
        return D.call(b.get("id"), b.get("name"), b.get("input"))
    if kind == "tool_result":
        return D.result(b.get("tool_use_id"), b.get("content"), bool(b.get("is_error")))
    return D.opaque(kind, b)


def claude_web(path: str, raw: bytes) -> Iterator[dict]:
    n = 0
    for _, c, error in _listed(raw):
        if error or not isinstance(c, dict) or not isinstance(c.get("chat_messages"), list):
            yield D.failed(n, error or "no messages")
            n += 1
            continue
        for m in c["chat_messages"]:
            if not isinstance(m, dict):
                yield D.failed(n, "not an object")
                n += 1
                continue
            parts = [_web_block(b) for b in m.get("content") or []]
            if m.get("text") and not any(p["type"] == "text" for p in parts):
                parts.insert(0, D.text(str(m["text"])))
            for a in m.get("attachments") or []:
                parts.append(D.file_ref(None, a.get("file_name"), a.get("file_type")))
                if a.get("extracted_content"):
                    parts.append(D.text(str(a["extracted_content"])))
            parts += [D.file_ref(f.get("file_uuid"), f.get("file_name")) for f in m.get("files") or []]
            up = m.get("parent_message_uuid")
            yield D.event(n, D.role_of(m.get("sender")), D.kind_of(parts), parts, native_id=m.get("uuid"), parent=None if up == _ZERO else up, time=m.get("created_at"), conversation=c.get("uuid"), title=c.get("name"))
            n += 1


def claude_design(path: str, raw: bytes) -> Iterator[dict]:
    for k, c, error in _listed(raw):
        if error or not isinstance(c, dict) or not isinstance(c.get("messages"), list):
            yield D.failed(k, error or "no messages")
            continue
        if not c["messages"]:
            yield D.skipped(k, "an empty chat")
        for n, m in enumerate(c["messages"]):
            body = m.get("content") if isinstance(m, dict) else None
            if not isinstance(body, dict):
                yield D.failed(n, "no content")
                continue
            parts: list[dict] = []
            for b in body.get("contentBlocks") or []:
                if isinstance(b, dict) and b.get("type") == "tool_call":
                    t = b.get("toolCall") or b
                    parts.append(D.call(t.get("id"), t.get("name"), t.get("input", t.get("arguments"))))
                    if "result" in t or "output" in t:
                        parts.append(D.result(t.get("id"), t.get("result", t.get("output"))))
                else:
                    parts.append(_web_block(b))
            if isinstance(body.get("content"), str) and body["content"] and not any(p["type"] == "text" for p in parts):
                parts.insert(0, D.text(body["content"]))
            parts += [D.file_ref(a.get("path"), a.get("name")) for a in body.get("attachments") or [] if isinstance(a, dict)]
            yield D.event(n, D.role_of(m.get("role")), D.kind_of(parts), parts, native_id=m.get("uuid"), time=m.get("created_at"), conversation=c.get("uuid"), title=c.get("title"), content_kind=body.get("kind"))


def perplexity(path: str, raw: bytes) -> Iterator[dict]:
    """An entry is a question and its answer."""
    try:
        whole = json.loads(raw)
        chats = whole["conversations"]
    except (ValueError, KeyError, TypeError) as e:
        yield D.failed(0, f"no conversations: {e}")
        return
    n = 0
    for c in chats:
        for e in c.get("entries") or []:
            ident = e.get("entry_uuid")
            base = {"time": e.get("created_at"), "conversation": c.get("context_uuid"), "title": c.get("context_title"), "mode": e.get("engine_mode"), "status": e.get("query_status")}
            q, a = (f"{ident}:{x}" if ident else None for x in ("query", "answer"))
            yield D.event(n, "user", "message", [D.text(str(e.get("query") or ""))], native_id=q, **base)
            if e.get("answer"):
                yield D.event(n, "assistant", "message", [D.text(e["answer"] if isinstance(e["answer"], str) else json.dumps(e["answer"]))], native_id=a, parent=q, **base)
            n += 1


# gemini_takeout


class _Markdown(HTMLParser):
    """HTML as Markdown: headings, emphasis, links, lists, code, tables."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[list] = []
        self.href: list[str] = []
        self.hush = 0
        self.pre = 0
        self.cells: list[str] | None = None
        self.rows = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head"):
            self.hush += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "article", "section", "blockquote", "nav"):
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre += 1
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.out.append("[")
        elif tag == "img":
            self.out.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            mark = "- "
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else "- "
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "table":
            self.rows = 0
            self.out.append("\n\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hush = max(0, self.hush - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.out.append(f"]({self.href.pop() if self.href else ''})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "tr" and self.cells is not None:
            self.out.append("| " + " | ".join(c.strip() for c in self.cells) + " |\n")
            if self.rows == 0:
                self.out.append("|" + "---|" * len(self.cells) + "\n")
            self.rows, self.cells = self.rows + 1, None

    def handle_data(self, value: str) -> None:
        if self.hush:
            return
        if not self.pre:
            value = re.sub(r"\s+", " ", value)
        if self.cells:
            self.cells[-1] += value
        else:
            self.out.append(value)


def markdown(source: str) -> str:
    """The page's text as Markdown, with at most one blank line between blocks."""
    parser = _Markdown()
    parser.feed(source.replace(" ", " "))
    parser.close()
    out = re.sub(r"[ \t]+\n", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


_MONTHS = {m: k // 2 + 1 for k, m in enumerate("jan jan fev feb mar mar abr apr mai may jun jun jul jul ago aug set sep out oct nov nov dez dec".split())}
_ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "BRT": -3, "WET": 0, "WEST": 1, "CET": 1, "CEST": 2, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def takeout_time(value: str) -> str | None:
    """A dated line of an activity page, English or Portuguese, as RFC 3339; no or an unknown zone is taken as UTC."""
    s = re.sub(r"\s+", " ", value.replace(" ", " ").replace(" ", " ")).strip()
    m = re.search(r"(?:([A-Za-z]{3,9})\.? (\d{1,2})|(\d{1,2}) (?:de )?([A-Za-zç]{3,9})\.?)(?: de)?,? (\d{4}),? (\d{1,2}):(\d\d)(?::(\d\d))?(?: ?([AP])\.?M\.?)?(?: ([A-Z]{1,4}|GMT)?([+-]\d{1,2}(?::?\d\d)?)?)?", s)
    if not m:
        return None
    month = _MONTHS.get((m[1] or m[4]).lower().replace("ç", "c")[:3])
    if month is None:
        return None
    hour = int(m[6]) % 12 + (12 if m[9] == "P" else 0) if m[9] else int(m[6])
    shift = m[11] or ""
    if shift:
        digits = shift[1:].replace(":", "")
        zone = f"{shift[0]}{int(digits[:-2] if len(digits) > 2 else digits):02d}:{digits[-2:] if len(digits) > 2 else '00'}"
    else:
        h = _ZONES.get(m[10] or "", 0)
        zone = f"{'-' if h < 0 else '+'}{abs(h):02d}:00"
    return f"{m[5]}-{month:02d}-{int(m[2] or m[3]):02d}T{hour:02d}:{m[7]}:{m[8] or '00'}{zone}"


def _turns(path: str, c: dict) -> Iterator[dict]:
    key = re.sub(r"\.(txt|json)$", "", path.replace("\\", "/").rsplit("/", 1)[-1])
    seen: dict[tuple, int] = {}
    last = None
    for n, t in enumerate(c.get("conversation_turns") or []):
        user, system = (t.get(f"{who}_turn") for who in ("user", "system"))
        own = user or system
        if not isinstance(own, dict):
            yield D.failed(n, "no turn")
            continue
        role = "user" if user else "assistant"
        place = (role, own.get("turn_index"))
        seen[place] = seen.get(place, -1) + 1
        native = f"{key}:{role}:{own.get('turn_index')}:{seen[place]}"
        if user:
            parts = [D.text(str(user.get("prompt") or ""))]
        else:
            parts = [D.reasoning(str(x)) for x in system.get("model_thoughts") or []]
            parts += [D.text(markdown(str(x["data"])) if "<" in str(x["data"]) else str(x["data"])) if isinstance(x, dict) and "data" in x else D.opaque("card", x) for x in system.get("text") or []]
            parts += [D.image(str(x)) for x in system.get("images") or []]
        yield D.event(n, role, D.kind_of(parts), parts, native_id=native, parent=last, time=own.get("turn_last_modified"), conversation=key, title=c.get("title"))
        last = native


def gemini_takeout(path: str, raw: bytes) -> Iterator[dict]:
    head = raw.lstrip(b"\xef\xbb\xbf \t\r\n")[:1]
    if head == b"<":
        yield from _activity_page(raw.decode("utf-8", "replace"))
        return
    n = 0
    for _, v, error in _listed(raw):
        if error or not isinstance(v, dict):
            yield D.failed(n, error or "not an object")
        elif "conversation_turns" in v:
            yield from _turns(path, v)
        elif "title" in v and "time" in v:
            asked = re.sub(r"^(Prompted|Said|Asked|Solicitou)\s+", "", str(v["title"]))
            ident = f"activity:{v['time']}"
            yield D.event(n, "user", "message", [D.text(asked)], native_id=ident + ":query", time=v["time"], conversation="my-activity", title=v.get("header"))
            answer = "\n\n".join(markdown(str(x.get("html", ""))) for x in v.get("safeHtmlItem") or [] if isinstance(x, dict))
            if answer:  # its own time isn't known: it is anchored to its question
                yield D.event(n, "assistant", "message", [D.text(answer)], native_id=ident + ":answer", parent=ident + ":query", conversation="my-activity")
        else:
            yield D.skipped(n, "not a turn")
        n += 1


def _activity_page(source: str) -> Iterator[dict]:
    """Cards are newest first: they are numbered from the oldest."""
    cards = re.split(r'<div[^>]*class="[^"]*outer-cell[^"]*"[^>]*>', source)[1:]
    previous = None
    n = 0
    for card in reversed(cards):
        body = re.search(r'<div[^>]*class="[^"]*content-cell[^"]*"[^>]*>(.*?)</div>', card, re.S)
        inner = (body[1] if body else card).replace(" ", " ")
        chunks = re.split(r"<br\s*/?>", inner)
        at = next((k for k, c in enumerate(chunks) if takeout_time(html.unescape(re.sub("<[^>]+>", "", c)))), None)
        if at is None:
            yield D.failed(n, "a card without a date")
            n += 1
            continue
        asked = re.sub(r"^(Prompted|Said|Asked|Solicitou)\s+", "", markdown("<br>".join(chunks[:at])))
        answer = markdown("<br>".join(chunks[at + 1 :]))
        time = takeout_time(html.unescape(re.sub("<[^>]+>", "", chunks[at])))
        if (asked, time) == previous:
            yield D.skipped(n, "a repeated card")
        else:
            ident = f"activity:{time}"
            yield D.event(n, "user", "message", [D.text(asked)], native_id=ident + ":query", time=time, conversation="my-activity")
            if answer:
                yield D.event(n, "assistant", "message", [D.text(answer)], native_id=ident + ":answer", parent=ident + ":query", conversation="my-activity")
        previous = (asked, time)
        n += 1
