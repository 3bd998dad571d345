"""Parsers, archives, imports and sinks on files written here."""

import collections
import gzip
import io
import json
import sqlite3
import tarfile
import tempfile
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talewright.archive import Archive
from talewright.plans import formats
from talewright.sinks import files
from talewright.sources import archives, drafts, exports, ingest, lines, registry, sessions, stores

SID = "11111111-2222-4333-8444-555555555555"


def claude_lines(n, start=0, text="say"):
    for k in range(start, n):
        role = "user" if k % 2 == 0 else "assistant"
        yield {"type": role, "uuid": f"00000000-0000-4000-8000-{k:012d}", "parentUuid": f"00000000-0000-4000-8000-{k - 1:012d}" if k else None, "sessionId": SID, "cwd": "/w", "gitBranch": "main", "isSidechain": False, "timestamp": f"2026-01-01T00:{k // 60:02d}:{k % 60:02d}Z", "message": {"role": role, "content": f"{text} {k}"}}


def jsonl(rows):
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


def outcomes(rows):
    return collections.Counter(r["outcome"] for r in rows)


def test_golden_chatgpt_ids(spark):
    chat = [{"id": "conv-1", "current_node": "b", "mapping": {"root": {"parent": None, "message": {"author": {"role": "user"}, "create_time": 1700000000.25, "content": {"parts": ["q"]}}}, "a": {"parent": "root", "message": {"author": {"role": "assistant"}, "create_time": 1700000001, "content": {"parts": ["x"]}}}, "b": {"parent": "root", "message": {"author": {"role": "assistant"}, "create_time": 1700000002, "content": {"parts": ["y"]}}}}}]
    df = spark.createDataFrame([("/x/conversations.json", bytearray(json.dumps(chat).encode()))], "path string, content binary")
    got = ingest.events(ingest.drafts(df)).select("conversation_id", "event_id", "seq", "native_id", "metadata").orderBy("seq").collect()
    assert {r.conversation_id for r in got} == {"cv_a01bbc899728b50416060391"}
    assert {r.event_id for r in got} == {"ev_e0d7cde0b0b9501284e88734", "ev_e37a20d2cd0d51b6b602e025", "ev_f20bcf59334463c24df8f579"}
    assert [json.loads(r.metadata)["current_path"] for r in got] == [True, False, True]


def test_claude_code():
    rows = [*claude_lines(2), {"type": "file-history-snapshot"}, {"type": "assistant", "uuid": "u", "sessionId": SID, "message": {"role": "assistant", "model": "m", "content": [{"type": "thinking", "thinking": "t"}, {"type": "tool_use", "id": "c1", "name": "ls", "input": {"b": 1, "a": 2}}]}}, {"type": "user", "sessionId": SID, "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": "out", "is_error": True}]}}, {"type": "user", "sessionId": SID, "isSidechain": True, "agentId": "a9", "message": {"role": "user", "content": "x"}}, {"type": "strange"}, {"uuid": "no type"}, {"type": "user"}]
    got = list(sessions.claude_code("/h/.claude/projects/p/s.jsonl", jsonl(rows) + b"\n[1]\n{bad"))
    assert outcomes(got) == {"event": 6, "skipped": 1, "failed": 4}
    e = [g for g in got if g["outcome"] == "event"]
    assert [x["event_type"] for x in e] == ["message", "message", "tool_call", "tool_result", "message", "opaque"]
    assert e[2]["content"][1]["arguments_json"] == '{"a":2,"b":1}' and e[3]["role"] == "tool" and e[3]["content"][0]["is_error"]
    assert e[4]["conversation_native"] == f"{SID}/agent-a9" and e[0]["branch"] == "main"


def test_codex():
    env = lambda t, p: {"timestamp": "2026-01-01T00:00:00Z", "type": t, "payload": p}
    rows = [env("session_meta", {"id": SID, "cwd": "/w", "git": {"branch": "b"}}), env("turn_context", {"model": "m1"}), env("response_item", {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}), env("event_msg", {"type": "user_message"}), env("response_item", {"type": "function_call", "call_id": "c", "name": "f", "arguments": "{\"x\":1}"}), env("turn_context", {"model": "m2"}), env("response_item", {"type": "function_call_output", "call_id": "c", "output": "ok"}), env("response_item", {"type": "reasoning", "summary": [], "encrypted_content": "zz"}), env("event_msg", {"type": "turn_aborted", "reason": "stop"}), env("response_item", {})]
    got = list(sessions.codex("rollout-1.jsonl", jsonl(rows)))
    e = [g for g in got if g["outcome"] == "event"]
    assert outcomes(got) == {"event": 6, "skipped": 3, "failed": 1}
    assert [x["native_id"] for x in e] == [f"{SID}:session_meta", None, "c:call", "c:output", None, None]
    assert [x.get("model") for x in e] == [None, None, "m1", None, "m2", None] and e[2]["content"][0]["arguments_json"] == '{"x":1}'
    assert [x["event_type"] for x in e] == ["system_note", "message", "tool_call", "tool_result", "reasoning", "interruption"]


def test_other_sessions():
    pi = [{"type": "title", "title": " T "}, {"type": "session", "version": 3, "id": SID, "cwd": "/w"}, {"type": "message", "id": "a", "parentId": None, "message": {"role": "bashExecution", "command": "ls", "output": "x", "exitCode": 1}}, {"type": "message", "id": "b"}]
    got = list(sessions.pi("x.jsonl", jsonl(pi)))
    assert outcomes(got) == {"event": 2, "skipped": 1, "failed": 1} and got[2]["title"] == "T" and [p["type"] for p in got[2]["content"]] == ["tool_call", "tool_result"]
    gem = [{"sessionId": SID, "projectHash": "h", "startTime": "2026-01-01T00:00:00Z"}, {"id": "m1", "type": "user", "content": "first"}, {"id": "m2", "type": "gemini", "content": "a", "toolCalls": [{"id": "c", "name": "f", "args": {}, "result": 1}]}, {"id": "m1", "type": "user", "content": "second"}, {"$set": {"sessionId": SID}}]
    got = [g for g in sessions.gemini_cli("s.jsonl", jsonl(gem)) if g["outcome"] == "event"]
    assert [(g["native_id"], g["content"][0].get("text")) for g in got] == [("m1", "second"), ("m2", "a"), ("m2/c", None)]
    mini = list(sessions.minimax("x/c2Vzcy0x/messages.jsonl", jsonl([{"id": "1", "message": {"role": "user", "content": "q"}}, {"x": 1}])))
    assert mini[0]["conversation_native"] == "sess-1" and mini[1]["outcome"] == "failed"
    anti = list(sessions.antigravity(f"/brain/{SID}/t.jsonl", jsonl([{"type": "USER_INPUT", "source": "USER_EXPLICIT", "step_index": 0, "content": "q"}, {"type": "PLANNER_RESPONSE", "source": "MODEL", "step_index": 1, "content": "a"}])))
    assert [a["role"] for a in anti] == ["user", "assistant"] and anti[0]["conversation_native"] == SID
    deep = list(sessions.deepseek("session.v4.jsonl", jsonl([{"type": "session", "session_id": "s"}, {"type": "telemetry"}, {"type": "m", "seq": 4, "role": "user", "content": "q"}])))
    assert [d["outcome"] for d in deep] == ["skipped", "skipped", "event"] and deep[2]["native_id"] == "seq-4"
    assert outcomes(sessions.generic_json("m.json", json.dumps([{"role": "ai", "content": "x"}, {"role": "user", "content": [1]}, 3]).encode())) == {"event": 1, "skipped": 1, "failed": 1}


def test_web_exports():
    web = [{"uuid": SID, "name": "n", "chat_messages": [{"uuid": "a", "sender": "human", "text": "hi", "content": [], "parent_message_uuid": "00000000-0000-4000-8000-000000000000"}, {"uuid": "b", "sender": "assistant", "content": [{"type": "text", "text": "yo"}], "attachments": [{"file_name": "f", "extracted_content": "E"}]}]}]
    got = list(exports.claude_web("conversations.json", json.dumps(web).encode()))
    assert got[0]["parent_native_id"] is None and [p["type"] for p in got[1]["content"]] == ["text", "file_ref", "text"]
    cut = json.dumps(web + web).encode()[:-40]
    assert outcomes(exports.claude_web("conversations.json", cut)) == {"event": 2, "failed": 1}
    pplx = {"conversations": [{"context_uuid": SID, "entries": [{"entry_uuid": "e", "query": "q", "answer": "a", "created_at": "2026-01-01T00:00:00Z"}]}]}
    assert [(g["native_id"], g["parent_native_id"]) for g in exports.perplexity("p.json", json.dumps(pplx).encode())] == [("e:query", None), ("e:answer", "e:query")]
    turns = {"title": "t", "conversation_turns": [{"user_turn": {"prompt": "q", "turn_index": 0}}, {"system_turn": {"text": [{"data": "<b>a</b>"}], "turn_index": 0}}, {"user_turn": {"prompt": "q2", "turn_index": 0}}]}
    got = list(exports.gemini_takeout("x/k.txt", json.dumps(turns).encode()))
    assert [g["native_id"] for g in got] == ["k:user:0:0", "k:assistant:0:0", "k:user:0:1"] and got[1]["content"][0]["text"] == "**a**"
    card = '<div class="outer-cell x"><div class="content-cell">Prompted hi<br>{}<br><p>ans</p></div></div>'
    page = "<html>" + "".join(card.format(t) for t in ("Jan 2, 2026, 3:04:05 PM EST", "Jan 1, 2026, 1:00:00 AM UTC", "Jan 1, 2026, 1:00:00 AM UTC")) + "</html>"
    got = list(exports.gemini_takeout("MyActivity.html", page.encode()))
    assert [g["outcome"] for g in got] == ["event", "event", "skipped", "event", "event"] and got[3]["timestamp_original"] == "2026-01-02T15:04:05-05:00" and got[4]["ts_ns"] is None
    assert exports.takeout_time("2 de jan. de 2026, 15:04:05 BRT") == "2026-01-02T15:04:05-03:00" and exports.takeout_time("no") is None
    design = {"uuid": SID, "title": "t", "messages": [{"uuid": "m", "role": "assistant", "content": {"kind": "k", "contentBlocks": [{"type": "tool_call", "toolCall": {"id": "c", "name": "f", "input": {}, "result": 1}}]}}]}
    assert [p["type"] for p in next(exports.claude_design("design_chats/a.json", json.dumps(design).encode()))["content"]] == ["tool_call", "tool_result"]


def test_markdown():
    html = "<h1>T</h1><p>a <b>b</b> <a href='u'>c</a></p><ul><li>x<li>y</ul><ol><li>1</ol><pre>k  k</pre><table><tr><th>h<th>i</tr><tr><td>1<td>2</tr></table><script>no</script>"
    assert exports.markdown(html) == "# T\n\na **b** [c](u)\n- x\n- y\n\n1. 1\n\n```\nk  k\n```\n\n| h | i |\n|---|---|\n| 1 | 2 |"


def sqlite_bytes(tmp_path, script):
    path = tmp_path / "db"
    con = sqlite3.connect(path)
    con.executescript(script)
    con.close()
    return path.read_bytes()


def test_stores(tmp_path):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    state = json.dumps({"type": "tool", "callID": "c", "tool": "ls", "state": {"status": "completed", "input": {}, "output": "x"}})
    db = sqlite_bytes(tmp_path / "a", f"""CREATE TABLE session(id, title, directory); CREATE TABLE message(id, session_id, time_created, time_updated, data); CREATE TABLE part(id, message_id, session_id, time_created, time_updated, data);
      INSERT INTO session VALUES ('ses_1', 't', '/w'); INSERT INTO message VALUES ('msg_1', 'ses_1', 1700000000000, 0, '{{"role":"assistant"}}'), ('msg_2', 'ses_1', 2, 0, '{{bad');
      INSERT INTO part VALUES ('prt_1', 'msg_1', 'ses_1', 1, 0, '{state}'), ('prt_2', 'msg_1', 'ses_1', 0, 0, '{{"type":"text","text":"hi"}}');""")
    got = list(stores.opencode("opencode.db", db))
    assert outcomes(got) == {"event": 2, "failed": 1} and [p["type"] for p in got[-2]["content"]] == ["text", "tool_call"] and got[-1]["native_id"] == "prt_1:result"
    db = sqlite_bytes(tmp_path / "b", """CREATE TABLE sessions(id, title, cwd, model, source, system_prompt, started_at); CREATE TABLE messages(id integer, session_id, role, content, tool_call_id, tool_calls, tool_name, timestamp, finish_reason, reasoning, active, compacted, _compressed_summary);
      INSERT INTO sessions VALUES ('s', 't', '/w', 'm', 'cli', 'be kind', 1.5); INSERT INTO messages VALUES (1, 's', 'user', 'q', NULL, NULL, NULL, 2.5, NULL, NULL, 1, 0, 0), (2, 's', 'tool', '{"error":"x"}', 'c', NULL, 'f', 3.5, NULL, NULL, 0, 0, 0), (3, 's', 'system', 'sum', NULL, NULL, NULL, 4.5, NULL, NULL, 1, 0, 1);""")
    got = list(stores.hermes("state.db", db))
    assert [g["event_type"] for g in got] == ["system_note", "message", "tool_result", "compaction"] and got[2]["content"][0]["is_error"] and json.loads(got[2]["metadata"])["inactive"]


def test_detection():
    best = lambda p, d: [x.id for x, _ in registry.detect(p, d)][:1]
    assert best("/a/.claude/projects/x.jsonl", jsonl(claude_lines(2))) == ["claude_code"]
    assert best("rollout-x.jsonl", jsonl([{"type": "session_meta", "payload": {}}])) == ["codex"]
    assert best("conversations.json", b'[{"mapping":{}}]') == ["chatgpt_export"]
    assert best("x.jsonl", b'{"role":"user","content":"x"}') == ["generic_jsonl"]
    assert best("x.bin", b"\0\1") == [] and registry.unsupported("/a/.codex/auth.json")[0] == "codex_state"


def test_lines_and_elements():
    assert [(n, x, s) for n, x, s in lines.lines(b"\xef\xbb\xbfa \r\n\n  \nbcd", 2)] == [(1, b"a", 1), (4, None, 3)]
    assert [v for _, v, _ in lines.elements(b'[1, {"a":2}, x]')] == [1, {"a": 2}, None]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=20), st.sampled_from([b'{"type":"user"}', b'{"type":1}', b"[]", b'{"role":"user","content":"x"}'])), max_size=12))
def test_every_line_has_one_outcome(parts):
    data = b"\n".join(p.replace(b"\n", b"") for p in parts)
    count = len(list(lines.lines(data)))
    for parse in (sessions.claude_code, sessions.codex, sessions.pi, sessions.generic_jsonl, sessions.deepseek, sessions.antigravity):
        assert len(list(parse("x.jsonl", data))) == count


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_safe_paths(name):
    try:
        path = archives.safe_path(name)
    except archives.ArchiveError:
        return
    assert archives.safe_path(path) == path and not path.startswith("/") and ".." not in path.split("/")


@settings(max_examples=100, deadline=None)
@given(st.datetimes(min_value=__import__("datetime").datetime(1700, 1, 1), max_value=__import__("datetime").datetime(2200, 1, 1)), st.integers(-14, 14))
def test_times_with_offsets(when, hours):
    text = when.strftime("%Y-%m-%dT%H:%M:%S.%f").zfill(26) + f"{'-' if hours < 0 else '+'}{abs(hours):02d}:00"
    base = drafts.rfc3339(when.strftime("%Y-%m-%dT%H:%M:%S.%f").zfill(26) + "Z")
    assert drafts.rfc3339(text) == base - hours * 3600 * 10**9 and drafts.rfc3339(text[:-6]) is None


def test_archives(monkeypatch):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("d/a.txt", b"A")
        z.writestr("../evil", b"E")
    outer = io.BytesIO()
    with tarfile.open(fileobj=outer, mode="w") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    got = list(archives.members("x.tar.gz", gzip.compress(outer.getvalue())))
    assert [(m.chain[-1], m.path, m.data) for m in got if m.data] == [("in.zip", "d/a.txt", b"A")]
    assert [m.path for m in got if m.error] == ["../evil"]
    with pytest.raises(archives.ArchiveError):
        archives.safe_path("C:x")
    monkeypatch.setattr(archives, "MAX_RATIO", 10)
    with pytest.raises(archives.ArchiveError):
        list(archives.members("b.gz", gzip.compress(b"\0" * (archives.RATIO_FROM * 2))))


def test_import(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_bytes(jsonl(claude_lines(10)))
    (src / "b.jsonl").write_bytes(jsonl(claude_lines(15)) + b"{bad\n")
    with zipfile.ZipFile(src / "c.zip", "w") as z:
        z.writestr("m.jsonl", jsonl([{"role": "user", "content": "password=hunter22", "id": "1"}, {"role": "x"}]))
    archive = Archive(spark, str(tmp_path / "out"))
    account = archive.import_([str(src)], run="r1").collect()
    assert all(r.balanced for r in account) and sum(r.imported for r in account) == 16 and sum(r.duplicate for r in account) == 10 and sum(r.failed for r in account) == 1
    seen = archive.need("observations").groupBy("event_id").count().groupBy("count").count().collect()
    assert {r[0]: r[1] for r in seen} == {1: 6, 2: 10}
    assert all(r.passed for r in archive.validate().collect())
    stats = archive.stats().first()
    assert (stats.events, stats.redacted_events, stats.parse_errors) == (16, 1, 1)
    assert "hunter22" not in str(archive.need("events").select(F.to_json(F.struct("content"))).collect())
    again = archive.import_([str(src)], run="r2").collect()
    assert sum(r.imported for r in again) == 0 and archive.need("events").count() == 16 and archive.need("observations").count() == 26
    (src / "a.jsonl").write_bytes(jsonl(claude_lines(1, text="edited")))
    archive.import_([str(src / "a.jsonl")], run="r3")
    assert archive.need("conflicts").count() == 1 and archive.need("events").where("variant_of is not null").count() == 1
    order = archive.export().where("variant_of is null and provider = 'anthropic'").collect()
    assert [r.seq for r in order] == list(range(15))
    lines_ = archive.records().collect()
    assert len(lines_) == 17 and lines_[0].conversation.event_count == 16 and len(lines_[0].source_refs) == 2 and json.loads(lines_[0].content)[0]["type"] == "text"
    assert set(archive.reports()) >= {"coverage.md", "errors.md"} and "claude_code" in archive.reports()["coverage.md"]
    assert archive.search("say 14").count() == 1 and archive.provenance(order[0].event_id).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "é")], "n long, s string")
    out = files.write_shards(df.coalesce(1), str(tmp_path / "d")).collect()
    assert out[0].records == 2
    (tmp_path / "d" / "x.jsonl.zst").write_bytes(__import__("zstandard").compress(b"{bad\n"))
    back = files.read_shards(spark, str(tmp_path / "d"), df.schema).cache()
    assert {(r.n, r.s) for r in back.where("_corrupt is null").collect()} == {(1, "é"), (2, "b")} and back.where("_corrupt is not null").count() == 1
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"yyyy"),), (None,)], "data binary")
    assert sorted((r.size, r.copied) for r in files.store_artifacts(blobs, str(tmp_path / "art"), most=2).collect()) == [(1, True), (4, False)]
    sums = [(r.path, r.sha256) for r in files.checksums(spark, str(tmp_path / "art")).collect()]
    assert len(sums) == 1 and sums[0][0].endswith(sums[0][1])
    a = files.pack(str(tmp_path / "d"), str(tmp_path / "1.pack"))
    assert a == files.pack(str(tmp_path / "d"), str(tmp_path / "2.pack"))
    assert len(files.unpack(str(tmp_path / "1.pack"), str(tmp_path / "u"))) == 2
    with pytest.raises(FileExistsError):
        files.unpack(str(tmp_path / "1.pack"), str(tmp_path / "u"))
    raw = bytearray((tmp_path / "1.pack").read_bytes())
    raw[len(raw) // 2] ^= 1
    (tmp_path / "3.pack").write_bytes(raw)
    with pytest.raises(Exception):
        files.unpack(str(tmp_path / "3.pack"), str(tmp_path / "v"))
    assert not (tmp_path / "v").exists()


def test_stream(spark, tmp_path):
    from talewright.streaming.ingest import stream

    src = tmp_path / "in"
    src.mkdir()
    run = lambda: stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (src / "a.jsonl").write_bytes(jsonl(claude_lines(4)))
    run()
    (src / "b.jsonl").write_bytes(jsonl(claude_lines(6)))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out" / "events")).count() == 6


def test_cli(tmp_path, capsys):
    from talewright import cli

    (tmp_path / "a.jsonl").write_bytes(jsonl(claude_lines(2)))
    assert cli.main(["discover", str(tmp_path)]) == 0 and "claude_code" in capsys.readouterr().out
    assert cli.main(["parsers"]) == 0 and cli.main(["inspect", str(tmp_path / "none")]) == 2
    assert cli.main(["pack", str(tmp_path), str(tmp_path.parent / f"{tmp_path.name}.pack")]) == 0


def test_local_stores(tmp_path):
    from talewright.sources import local_stores as L

    home = tmp_path / "home"
    for p in (".claude/projects/p/s.jsonl", ".claude/projects/p/x.txt", ".hermes/state.db", ".hermes/state.db-wal", ".hermes/other.db", ".codex/sessions/2026/r.jsonl", ".config/Claude/db/CURRENT", ".config/Claude/db/MANIFEST-1", ".config/Claude/db/1.ldb"):
        (home / p).parent.mkdir(parents=True, exist_ok=True)
        (home / p).write_bytes(b"see https://claude.ai here")
    got = sorted((a, p[len(str(home)) + 1 :]) for a, p in L.candidates({"HOME": str(home)}, windows=False))
    assert got == [("claude-code", ".claude/projects/p/s.jsonl"), ("codex", ".codex/sessions/2026/r.jsonl"), ("hermes", ".hermes/state.db"), ("hermes", ".hermes/state.db-wal")]
    db = str(home / ".config/Claude/db")
    assert L.is_leveldb(db) and L.leveldb_inventory(db)["origins"] == ["https://claude.ai"]
    assert L.glob_matches("a/**/*.json", "a/x/y.json") and L.glob_matches("a/**/*.json", "a/y.json") and not L.glob_matches("a/*.json", "a/x/y.json")


def test_databases_need_no_files(monkeypatch):
    turns = [(0, "user", "a"), (1, "assistant", "b")]
    monkeypatch.setattr(tempfile, "TemporaryDirectory", None)
    for name in ("opencode", "hermes"):
        path, data = formats.FORMATS[name](7, turns)
        assert [d["content"][0]["text"] for d in registry.BY_ID[name].parse(path, data) if d["outcome"] == "event"] == ["a", "b"]


def test_a_database_with_a_log_is_opened_too(tmp_path):
    con = sqlite3.connect(tmp_path / "db")
    con.execute("PRAGMA journal_mode = wal")
    con.execute("CREATE TABLE t(a)")
    con.execute("INSERT INTO t VALUES (1)")
    con.commit()
    db = stores.Database((tmp_path / "db").read_bytes(), (tmp_path / "db-wal").read_bytes())
    con.close()
    assert [r["a"] for r in db.rows("SELECT a FROM t")] == [1]
    db.close()
    db = stores.Database((tmp_path / "db").read_bytes())  # the log is in the file, which says still that it had one
    assert db.folder and db.tables() == {"t"}
    db.close()


def test_conversations_are_spread_over_tasks(spark, sf):
    made = formats.written(spark, sf, "generic_json")
    assert made.rdd.getNumPartitions() == 4 and made.count() == 20
