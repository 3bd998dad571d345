"""What an archive keeps, publishes and finds again."""

import io
import json
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from talewright.archive import Archive
from talewright.operators import classify, report, validate
from talewright.sinks import files
from talewright.sources import archives, ingest, local_stores, registry, repository

SID = "11111111-2222-4333-8444-555555555555"


def session(rows):
    return "".join(json.dumps({"uuid": f"u{k}", "sessionId": SID, "cwd": "/w", "timestamp": f"2026-01-01T00:00:{k:02d}Z", **r}) + "\n" for k, r in enumerate(rows)).encode()


def says(text, role="user"):
    return {"type": role, "message": {"role": role, "content": text}}


def test_long_texts_and_outputs_are_kept_whole(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    text = "é" * 20_000 + " needle"
    output = {"rows": ["x" * 100] * 500, "last": "haystack"}
    rows = [says("short"), says(text), {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c", "content": output}]}}]
    (src / "a.jsonl").write_bytes(session(rows))
    archive = Archive(spark, str(tmp_path / "out"))
    archive.import_([str(src)], run="r1")
    third, first, second = (r.content[0] for r in archive.need("events").orderBy("seq").collect())
    assert len(first.text.encode()) <= 32 << 10 and first.truncation.full_bytes == len(text.encode()) and third.truncation is None
    ref = json.loads(second.output_json)
    assert ref["artifact_ref"]["bytes"] == second.truncation.full_bytes and len(ref["inline_preview"].encode()) <= 32 << 10
    stored = {r.sha256: r for r in archive.need("artifacts").collect()}
    assert set(stored) == {first.truncation.full_sha256, second.truncation.full_sha256} and all(r.copied and r.artifact_id.startswith("art_") for r in stored.values())
    path = tmp_path / "out/artifacts/sha256" / first.truncation.full_sha256[:2] / first.truncation.full_sha256
    assert path.read_text() == text
    assert archive.search("needle").count() == 1 and archive.search("haystack").count() == 1
    whole = ingest.with_whole_texts(archive.need("events"), str(tmp_path / "out/artifacts")).orderBy("seq").collect()
    assert whole[1].content[0].text == text and json.loads(whole[2].content[0].output_json) == output


def test_runs_are_published_as_a_whole_and_resumed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_bytes(session([says("one"), says("two")]))
    archive = Archive(spark, str(tmp_path / "out"))
    archive.import_([str(src)], run="r1")
    assert archive.files.names(".staging") == [] and archive.runs() == ["r1"]
    archive.files.move("_runs/r1", "_runs/r1.part")  # as a crash before the last step leaves it
    assert archive.table("events") is None
    archive.import_([str(src)], run="r1")
    assert archive.need("events").count() == 2 and archive.need("observations").count() == 2
    (src / "b.jsonl").write_bytes(session([says("three")]).replace(b"u0", b"u9"))
    account = archive.import_([str(src)], run="r2", resume=True).collect()
    assert [r.source_path.rsplit("/", 1)[1] for r in account] == ["b.jsonl"]
    assert archive.import_([str(src)], run="r3", resume=True).count() == 0 and archive.need("events").count() == 3
    with pytest.raises(LookupError):
        archive.provenance("ev_none")
    with pytest.raises(LookupError):
        archive.inspect_event("ev_none")


def test_a_damaged_dataset_fails_its_checks(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_bytes(session([says("one"), says("two", "assistant")]))
    archive = Archive(spark, str(tmp_path / "out"))
    archive.import_([str(src)], run="r1")
    manifest = archive.write_dataset()
    assert manifest["counts"]["events"] == 2 and sum(s["records"] for s in manifest["event_shards"]) == 2
    from talewright import dataset

    checks = archive.validate().collect()
    assert len(checks) == 10 and all(r.passed for r in checks)
    shard = tmp_path / "out/dataset" / manifest["event_shards"][0]["path"]
    shard.write_bytes(shard.read_bytes() + b"x")
    (tmp_path / "out/dataset/more.txt").write_text("x")
    found = {r["check"]: r for r in dataset.validate(archive).collect()}
    assert not found["checksums"].passed and found["checksums"].failures == 2 and not found["manifest_shards"].passed and found["manifest"].passed


def test_observations_without_a_parser_stay_one(spark):
    df = spark.createDataFrame([(0, "a", "1", "s", 1, None)], "ord long, event_id string, content_fp string, source_id string, record_index long, parser string")
    done = classify.classify(df)
    assert classify.observations(done, classify.observations(done)).count() == 0


def test_single_files(spark, tmp_path, capsys):
    choose = lambda *a, **k: files.compressed(*a, **k)
    assert [choose("a.jsonl", harness=False), choose("a.zst", harness=False), choose("a", harness=True), choose("-", harness=True), choose("a.zst", harness=True, flag=False), choose("-", harness=False, flag=True)] == [False, True, True, False, False, True]
    df = spark.createDataFrame([(k, f"é{k}") for k in range(5)], "k int, line string").orderBy("k").select("line")
    assert files.write_single(df, str(tmp_path / "a.txt"), compress=False) == 5 and (tmp_path / "a.txt").read_text().split() == [f"é{k}" for k in range(5)]
    files.write_single(df, str(tmp_path / "a.zst"), compress=True)
    assert zstandard.ZstdDecompressor().stream_reader((tmp_path / "a.zst").read_bytes()).read() == (tmp_path / "a.txt").read_bytes()
    assert files.write_single(df, "-", compress=False) == 5 and capsys.readouterr().out.split()[-1] == "é4"


def test_a_tar_that_breaks_off():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name in ("a", "b"):
            info = tarfile.TarInfo(name)
            info.size = 3000
            t.addfile(info, io.BytesIO(name.encode() * 3000))
    got = list(archives.members("x.tar", out.getvalue()[:5000]))
    assert [(m.path, m.data) for m in got if m.data] == [("a", b"a" * 3000)] and any(m.error for m in got)


def test_repositories(tmp_path):
    own = tmp_path / "r/a/b"
    own.mkdir(parents=True)
    assert repository.git_remote(str(own)) is None
    (tmp_path / "r/.git").mkdir()
    (tmp_path / "r/.git/config").write_text('[remote "x"]\n  fetch = f\n  url = "git@h:o/r"\n[remote "y"]\n url = z\n')
    assert repository.git_remote(str(own)) == "git@h:o/r"


def test_survey_and_known_files(tmp_path):
    for name, data in (("a.txt", b"x"), ("empty.txt", b""), ("x.png", b"x"), ("zip.png", b"PK\3\4x"), ("db/CURRENT", b"1"), ("db/MANIFEST-1", b"22")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {path[len(str(tmp_path)) + 1 :]: (size, problem) for path, size, _, problem in ingest.survey(str(tmp_path))}
    assert got == {"a.txt": (1, None), "empty.txt": (0, "empty"), "x.png": (1, "extension"), "zip.png": (5, None), "db": (3, "leveldb")}
    assert registry.unsupported("C:\\x\\y.db-wal")[0] == "sqlite_companion" and registry.unsupported("/e/projects/p.json", b'{"prompt_template": 1}')[0] == "claude_export_projects"
    assert registry.unsupported("/e/readme.txt") is None and len(registry.UNSUPPORTED) > 50
    assert local_stores.leveldb_inventory(str(tmp_path / "db"))["bytes"] == 3


def test_compact_export_lines(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    rows = [says("one"), says("<system-reminder>x"), {"type": "user", "isSidechain": True, "agentId": "a", "message": {"role": "user", "content": "side"}}]
    (src / "a.jsonl").write_bytes(session(rows))
    archive = Archive(spark, str(tmp_path / "out"))
    archive.import_([str(src)], run="r1")
    lines = [json.loads(r.line) for r in archive.harness_lines().collect()]
    heads, events = [x for x in lines if "conversation" in x["schema"]], [x for x in lines if "conversation" not in x["schema"]]
    assert lines[: len(heads)] == heads and len(heads) == 2 and [x["conversation_id"] for x in heads] == sorted(x["conversation_id"] for x in heads)
    assert [e["event_type"] for e in events] == ["message", "control", "message"] and [e["hidden"] for e in events] == [False, True, True]
    assert events[0]["machine_id"] is None and events[0]["project_id"] and "branch" not in events[0] and "subagent" in events[2] and events[0]["source_refs"][0]["record_index"] == 1
    assert archive.records().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).count() == 3


def test_every_event_seen_twice_is_listed(spark):
    observations = spark.createDataFrame([(f"e{k:04d}", s, f"/{s}") for k in range(501) for s in ("s1", "s2")], "event_id string, source_id string, source_path string")
    sources = spark.createDataFrame([("s1", "/s1"), ("s2", "/s2")], "source_id string, source_path string")
    found = validate.multi_observed(observations, sources).collect()
    assert [r.event_id for r in found] == [f"e{k:04d}" for k in range(501)] and {(r.n, r.paths) for r in found} == {(2, "/s1,/s2")}
    page = report.markdown_table(validate.multi_observed(observations, sources), title="Twice")
    assert page.count("\n| e0") == 500 and page.endswith("The first 500 of 501 rows.\n")


def test_every_failure_is_listed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.jsonl").write_bytes(session([says("one"), says("two")]) + b"{broken\n" * 501)
    archive = Archive(spark, str(tmp_path / "out"))
    archive.import_([str(src)], run="r1")
    text = archive.reports()["errors.md"]
    assert text.count("\n| src_") == 501 and "The first" not in text
    files.write_lines(tmp_path / "errors.md", archive.report_lines()["errors.md"])
    assert (tmp_path / "errors.md").read_text() == text


def test_small_files_share_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"src/d{k}").mkdir(parents=True)
        (tmp_path / f"src/d{k}/a b+%41.jsonl").write_bytes(session([says(f"text {k}")]))
    read = ingest.read(spark, [str(tmp_path / "src")])
    assert read.rdd.getNumPartitions() == 4  # one for each core here, not by a cost for opening each
    assert {r.source_path for r in read.collect()} == {str(tmp_path / f"src/d{k}/a b+%41.jsonl") for k in range(200)}
    blobs = spark.createDataFrame([(bytearray(f"blob {k}".encode()),) for k in range(200)], "data binary")
    stored = files.store_artifacts(blobs, str(tmp_path / "store")).collect()
    (tmp_path / "store/sha256" / stored[0].sha256[:2] / stored[0].sha256).unlink()
    found = files.read_artifacts(spark.createDataFrame(stored), str(tmp_path / "store"))
    assert found.rdd.getNumPartitions() == 4 and {r.sha256 for r in found.collect()} == {r.sha256 for r in stored[1:]}
    there = files.stored_artifacts(spark, str(tmp_path / "store")).collect()
    assert sorted((r.name, r.sha256, r.size) for r in there) == sorted((r.sha256, r.sha256, r.size) for r in stored[1:])


def test_many_files_are_synced_once(tmp_path, monkeypatch):
    synced = []
    monkeypatch.setattr(files, "_sync", lambda folder: synced.append(sorted(p.name.endswith(".part") for p in tmp_path.rglob("*") if p.is_file())))
    files.write_many([(tmp_path / f"d{k}/a", f"text {k}".encode()) for k in range(5)])
    assert synced == [[True] * 5] and [(tmp_path / f"d{k}/a").read_text() for k in range(5)] == [f"text {k}" for k in range(5)]
    (tmp_path / "e").mkdir()
    with pytest.raises(OSError):
        files.write_many([(tmp_path / "e/x", b"1"), (tmp_path / "d0/a/y", b"2")])
    assert list((tmp_path / "e").iterdir()) == []
