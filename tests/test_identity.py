"""Prefix rules, projects, exported records and configuration."""

import json

import pytest
from pyspark.sql import functions as F

from talewright import config
from talewright.functions.parts import PART
from talewright.operators import export_records, identity


@pytest.mark.parametrize("bound", [10_000, 0])
def test_prefix_rules(spark, monkeypatch, bound):
    monkeypatch.setattr(identity, "BROADCAST_RULES", bound)
    df = spark.createDataFrame([("/home/a/x",), ("/home/ab",), ("C:\\Work\\p",), (None,), ("/home/a",), ("/srv",)], "path string")
    rules = spark.createDataFrame([(0, "/home/a", "m1"), (1, "/home", "m2"), (2, "c:/work/", "m3")], "ord int, prefix string, machine string")
    got = {r.path: r.m for r in identity.by_prefix(df, rules, path_col="path", value_col="machine", into="m").collect()}
    assert got == {"/home/a/x": "m1", "/home/ab": "m2", "C:\\Work\\p": "m3", None: None, "/home/a": "m1", "/srv": None}


def test_projects(spark):
    df = spark.createDataFrame([("/w/a", "git@h.com:o/r.git"), ("/w/b", None), ("/x/c", "https://h.com/o/r"), (None, None)], "working_directory string, remote string")
    alias = spark.createDataFrame([(0, "/w/b", "Named")], "ord int, prefix string, project string")
    got = {r.working_directory: r for r in identity.projects(df, alias).collect()}
    assert got["/w/a"].project_id == got["/x/c"].project_id and got["/w/a"].project_name == "r"
    assert got["/w/b"].project_name == "Named" and got[None].project_id is None


def test_blocks(spark):
    parts = [{"type": "text", "text": 'a"\né'}, {"type": "reasoning", "text": "t", "visibility": "public"}, {"type": "tool_result", "tool_call_id": "c", "output_json": '{"a":1}', "is_error": False}, {"type": "opaque", "kind": "k", "raw_json": "null"}, {"type": "file_ref", "filename": "f"}]
    df = spark.createDataFrame([([{n: p.get(n) for n in PART.fieldNames()} for p in parts],)], "content array<" + PART.simpleString() + ">")
    got = json.loads(df.select(export_records.blocks(F.col("content"))).first()[0])
    assert got == [{"type": "text", "text": 'a"\né'}, {"type": "thinking", "text": "t", "visibility": "public"}, {"type": "tool_result", "call_id": "c", "output": {"a": 1}, "is_error": False}, {"type": "opaque", "kind": "k", "raw": None}, {"type": "attachment", "kind": "file", "filename": "f"}]


def test_config(spark):
    c = config.load('[[machine]]\nid = "m"\npaths = ["/a", "/b"]\n[secrets]\npolicy = "preserve"\n[limits]\nmax_depth = 3\n')
    assert c.limits.max_depth == 3 and c.limits.max_files == 2_000_000 and c.machine_rules(spark).count() == 2 and c.project_rules(spark).count() == 0
    for bad in ("[other]\n", "[limits]\nx = 1\n", '[secrets]\npolicy = "no"\n'):
        with pytest.raises(ValueError):
            config.load(bad)
