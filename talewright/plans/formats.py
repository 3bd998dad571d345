"""Each conversation of the test table as a file of every known format, read back by detection and that format's parser."""

from __future__ import annotations

import base64
import datetime as dt
import json
import sqlite3
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from .records import _ROLE, table

START = 1_700_000_000
Turn = tuple[int, str, str]


def seconds(conv: int, turn: int) -> int:
    return START + conv * 1000 + turn


def iso(conv: int, turn: int) -> str:
    return dt.datetime.fromtimestamp(seconds(conv, turn), dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _lines(rows: list[dict]) -> bytes:
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


def _block(text: str) -> list[dict]:
    return [{"type": "text", "text": text}]


def _database(script: list[tuple[str, list[tuple]]]) -> bytes:
    """The bytes of a database made by statements, each with its rows."""
    con = sqlite3.connect(":memory:")
    try:
        for sql, rows in script:
            con.executemany(sql, rows) if rows else con.execute(sql)
        con.commit()
        return con.serialize()
    finally:
        con.close()


def claude_code(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return ".claude/projects/s.jsonl", _lines([{"type": "assistant" if r == "assistant" else "user", "uuid": f"u-{c}-{k}", "sessionId": f"s-{c}", "timestamp": iso(c, k), "message": {"role": r, "content": _block(t)}} for k, r, t in turns])


def codex(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    line = lambda k, kind, p: {"timestamp": iso(c, k), "type": kind, "payload": p}
    return "rollout-1.jsonl", _lines([line(0, "session_meta", {"id": f"s-{c}"}), *[line(k, "response_item", {"type": "message", "role": r, "content": [{"type": "input_text", "text": t}]}) for k, r, t in turns]])


def chatgpt_export(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    nodes = {f"n{k}": {"parent": f"n{turns[i - 1][0]}" if i else None, "message": {"author": {"role": r}, "create_time": float(seconds(c, k)), "content": {"parts": [t]}}} for i, (k, r, t) in enumerate(turns)}
    return "conversations.json", json.dumps([{"id": f"c-{c}", "mapping": nodes}]).encode()


def claude_web_export(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "conversations.json", json.dumps([{"uuid": f"c-{c}", "name": "n", "chat_messages": [{"uuid": f"m{k}", "sender": r, "content": _block(t), "created_at": iso(c, k)} for k, r, t in turns]}]).encode()


def claude_design_export(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "design_chats/a.json", json.dumps({"uuid": f"c-{c}", "title": "t", "messages": [{"uuid": f"m{k}", "role": r, "content": {"contentBlocks": _block(t)}, "created_at": iso(c, k)} for k, r, t in turns]}).encode()


def gemini_takeout(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    one = lambda k, r, t: {"user_turn": {"prompt": t, "turn_index": k, "turn_last_modified": iso(c, k)}} if r == "user" else {"system_turn": {"text": [{"data": t.replace("<", "(")}], "turn_index": k, "turn_last_modified": iso(c, k)}}
    return "chat.txt", json.dumps({"title": "t", "conversation_turns": [one(*t) for t in turns]}).encode()


def perplexity_export(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    entries = [{"entry_uuid": f"e{k}", "query": t, "answer": f"re: {t}", "created_at": iso(c, k)} for k, _, t in turns]
    return "p.json", json.dumps({"conversations": [{"context_uuid": f"c-{c}", "entries": entries}]}).encode()


def opencode(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "opencode.db", _database([
        ("CREATE TABLE session(id, title, directory)", []), ("CREATE TABLE message(id, session_id, time_created, time_updated, data)", []), ("CREATE TABLE part(id, message_id, session_id, time_created, time_updated, data)", []),
        ("INSERT INTO session VALUES (?, 't', '/w')", [(f"ses_{c}",)]),
        ("INSERT INTO message VALUES (?, ?, ?, 0, ?)", [(f"msg_{k:06d}", f"ses_{c}", seconds(c, k) * 1000, json.dumps({"role": r})) for k, r, _ in turns]),
        ("INSERT INTO part VALUES (?, ?, ?, 0, 0, ?)", [(f"prt_{k}", f"msg_{k:06d}", f"ses_{c}", json.dumps({"type": "text", "text": t})) for k, _, t in turns]),
    ])


def _pi(c: int, turns: list[Turn]) -> list[dict]:
    return [{"type": "session", "version": 3, "id": f"s-{c}", "timestamp": iso(c, 0)}, *[{"type": "message", "id": f"m{k}", "timestamp": iso(c, k), "message": {"role": r, "content": _block(t)}} for k, r, t in turns]]


def pi(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "s.jsonl", _lines(_pi(c, turns))


def oh_my_pi(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "s.jsonl", _lines([{"type": "title", "title": "T"}, *_pi(c, turns)])


def hermes(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "state.db", _database([
        ("CREATE TABLE sessions(id, title, cwd, model, source, system_prompt, started_at)", []),
        ("CREATE TABLE messages(id integer, session_id, role, content, tool_call_id, tool_calls, tool_name, timestamp, finish_reason, reasoning, active, compacted, _compressed_summary)", []),
        ("INSERT INTO sessions VALUES (?, 't', '/w', 'm', 'cli', NULL, 1.5)", [(f"{c}",)]),
        ("INSERT INTO messages VALUES (?, ?, ?, ?, NULL, NULL, NULL, ?, NULL, NULL, 1, 0, 0)", [(k, f"{c}", r, t, float(seconds(c, k))) for k, r, t in turns]),
    ])


def gemini_cli(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    """Each message is written twice: the last writing counts, at the first one's place."""
    rows = [{"id": f"m{k}", "type": "gemini" if r == "assistant" else r, "content": t, "timestamp": iso(c, k)} for k, r, t in turns]
    return ".gemini/tmp/h/chats/session-1.jsonl", _lines([{"sessionId": f"s-{c}", "projectHash": "h", "startTime": iso(c, 0)}, *[r | {"content": "a draft"} for r in rows], *reversed(rows)])


def antigravity(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    kind = {"user": ("USER_INPUT", "USER_EXPLICIT"), "assistant": ("PLANNER_RESPONSE", "MODEL")}
    rows = [{"type": kind.get(r, ("NOTE", "SYSTEM"))[0], "source": kind.get(r, ("NOTE", "SYSTEM"))[1], "step_index": k, "content": t, "created_at": iso(c, k)} for k, r, t in turns]
    return f"brain/{c:08d}-0000-4000-8000-000000000000/t.jsonl", _lines(rows)


def minimax(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return f"{base64.urlsafe_b64encode(f's-{c}'.encode()).decode().rstrip('=')}/messages.jsonl", _lines([{"id": f"m{k}", "timestamp": iso(c, k), "message": {"role": r, "content": _block(t)}} for k, r, t in turns])


def deepseek(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "session.v4.jsonl", _lines([{"type": "session", "session_id": f"s-{c}"}, *[{"type": "m", "seq": k, "role": r, "content": t, "timestamp": iso(c, k)} for k, r, t in turns]])


def generic_json(c: int, turns: list[Turn]) -> tuple[str, bytes]:
    return "m.json", json.dumps([{"role": r, "content": t, "id": f"m{k}", "timestamp": iso(c, k)} for k, r, t in turns]).encode()


FORMATS: dict[str, Callable[[int, list[Turn]], tuple[str, bytes]]] = {
    f.__name__: f for f in (claude_code, codex, chatgpt_export, claude_web_export, claude_design_export, gemini_takeout, perplexity_export, opencode, pi, oh_my_pi, hermes, gemini_cli, antigravity, minimax, deepseek, generic_json)
}


#: Turns that a task makes files of, and bytes of files in a batch.
TASK_TURNS, BATCH_BYTES = 5000, 4 << 20


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turns) in tasks by the number of turns; a task has some of each size of conversation."""
    rows = table(spark, sf_dir, "conversations")
    many = rows.count()
    tasks = max(1, min(many, spark.sparkContext.defaultParallelism), -(-many // TASK_TURNS))
    return rows.repartition(tasks, "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def written(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(path, content): a file of the format for each conversation, below a folder with its number."""
    make = FORMATS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])
        out, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                c = b.column(0)[k].as_py()
                path, data = make(c, [(t["turn"], t["role"], t["text"]) for t in b.column(1)[k].as_py()])
                out.append((f"/data/conv-{c}/{path}", data))
                size += len(data)
                if size >= BATCH_BYTES:
                    yield give(out)
                    out, size = [], 0
        yield give(out)

    return conversations(spark, sf_dir).mapInArrow(run, "path string, content binary")


def parsed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = ingest.events(ingest.drafts(written(spark, sf_dir, name), keep_secrets=True), max_inline=0)
        text = F.get(F.filter("content", lambda p: p["type"] == "text"), F.lit(0))["text"]
        return e.select(F.regexp_extract("source_path", r"conv-(\d+)/", 1).cast("long").alias("conv_id"), "seq", "parser", "role", "event_type", F.sha2(text, 256).alias("text_sha256"), "ts_ns", "timestamp_confidence")

    query.__name__ = f"parsed_{name}"
    query.__doc__ = f"Detection and parsing of {name} files."
    return query


QUERIES = {f"parsed_{name}": parsed(name) for name in FORMATS}


def _sql(name: str) -> str:
    role = {"gemini_takeout": "CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END", "antigravity": "CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'system' END", "perplexity_export": "'user'"}.get(name, _ROLE)
    kind = {"antigravity": "CASE WHEN role IN ('user', 'assistant') THEN 'message' ELSE 'system_note' END"}.get(name, "'message'")
    text = "CASE WHEN role = 'user' THEN text ELSE replace(text, '<', '(') END" if name == "gemini_takeout" else "text"
    conf = {"chatgpt_export": "provider_derived", "hermes": "provider_derived", "opencode": "database_derived"}.get(name, "exact")
    header = int(name in ("codex", "pi", "oh_my_pi"))
    place = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"
    time = f"({START} + conv_id * 1000 + turn) * 1000000000"
    row = f"SELECT conv_id, {place} + {header} AS seq, '{name}' AS parser, {role} AS role, {kind} AS event_type, sha256({text}) AS text_sha256, {time} AS ts_ns, '{conf}' AS timestamp_confidence FROM conversations"
    if name == "perplexity_export":
        return f"SELECT * REPLACE (2 * seq AS seq) FROM ({row}) UNION ALL SELECT conv_id, 2 * ({place}) + 1, '{name}', 'assistant', 'message', sha256('re: ' || text), {time}, '{conf}' FROM conversations"
    if header:
        extra = f"SELECT conv_id, 0, '{name}', 'system', 'system_note', NULL, ({START} + conv_id * 1000) * 1000000000, 'exact' FROM conversations GROUP BY conv_id"
        return f"{row} UNION ALL {extra}"
    return row


SQL = {f"parsed_{name}": _sql(name) for name in FORMATS}
