"""Classification against a sequential loop, export order, anchors, search."""

import random

from pyspark.sql import functions as F

from talewright.operators import classify, export, ledger, search

FP = lambda e, f: F.concat_ws("/", e, f)


def loop(arrivals, archive):
    """One arrival after the other, as a ledger would take them."""
    base, variants, out = dict(archive), {k for k, _ in archive}, {}
    for ordinal, event, fp in arrivals:
        if event not in base:
            base[event], out[ordinal] = fp, ("new", event)
        elif base[event] == fp:
            out[ordinal] = ("duplicate", event)
        else:
            v = f"{event}/{fp}"
            out[ordinal] = ("variant_duplicate" if v in variants else "variant_new", v)
            variants.add(v)
    return out


def test_classify_is_the_loop(spark):
    rng = random.Random(7)
    for case in range(4):
        rows = [(k, f"e{rng.randint(0, 6)}", f"f{rng.randint(0, 2)}") for k in range(40)]
        archive = [("e1", "f0"), ("e2", "f1"), ("e1/f2", "f2")] if case % 2 else []
        df = spark.createDataFrame(rows, "ord long, event_id string, content_fp string")
        known = spark.createDataFrame(archive, "event_id string, content_fp string") if archive else None
        got = {r.ord: (r.status, r.stored_id) for r in classify.classify(df, known, variant=FP).collect()}
        assert got == loop(rows, archive)


def test_reimport_adds_nothing(spark):
    df = spark.createDataFrame([(0, "a", "1", "s", None, "p"), (1, "a", "2", "s", 4, "p"), (2, "b", "1", "s", 5, "p")], "ord long, event_id string, content_fp string, source_id string, record_index long, parser string")
    first = classify.classify(df, variant=FP)
    stored = first.where(F.col("status").isin("new", "variant_new")).select(F.col("stored_id").alias("event_id"), "content_fp")
    again = classify.classify(df, stored, variant=FP)
    assert {r.status for r in again.collect()} == {"duplicate", "variant_duplicate"}
    assert classify.observations(again, classify.observations(first)).count() == 0
    assert classify.conflicts(again, classify.conflicts(first)).count() == 0
    assert all(r.balanced for r in classify.accounting(again).collect())


EVENT = "event_id string, conversation_id string, session_id string, seq long, ts_ns long, timestamp_confidence string, parent_event_id string, parent_native_id string, native_id string, shard_ord long"


def test_export_order(spark):
    rows = [
        ("e3", "c1", None, 2, 200, "exact", None, None, None, 0),
        ("e1", "c1", None, 0, 100, "exact", None, None, "n1", 1),
        ("e2", "c1", None, 1, None, "unknown", None, "n1", None, 2),  # takes e1's place in time
        ("e4", "c0", None, 0, 100, "provider_derived", None, None, None, 3),
        ("e5", "c9", None, 0, None, "unknown", None, None, None, 4),
        ("e6", "c0", None, 1, None, "sequence_only", None, None, None, 5),
        ("e1", "c1", None, 0, 999, "exact", None, None, "n1", 6),  # a later copy
    ]
    got = [r.event_id for r in export.chronological(spark.createDataFrame(rows, EVENT)).collect()]
    assert got == ["e1", "e2", "e4", "e3", "e6", "e5"]


def test_anchor_depth(spark):
    rows = [("0", None, 5, 0)] + [(str(k), str(k - 1), None, 5) for k in range(1, 30)] + [("x", "y", None, 5), ("y", "x", None, 5)]
    df = spark.createDataFrame(rows, "event_id string, parent_event_id string, ts_ns long, rank int")
    got = {r.event_id: r.anchor_ns for r in export.anchored(df).collect()}
    assert [got[str(k)] for k in range(30)] == [5] * 22 + [None] * 8 and got["x"] is None


def test_search(spark):
    docs = spark.createDataFrame([("a", "The Café is open"), ("b", "open the cafe"), ("c", None), ("d", "closed caf-é")], "event_id string, text string")
    index = search.postings(docs)
    ids = lambda q: sorted(r.id for r in search.match(index, q).collect())
    assert ids("cafe open") == ["a", "b"]
    assert ids("the-cafe") == ["a", "b"]
    assert ids("is-open") == ["a"]
    assert ids("") == [] and ids('"') == []
    assert [r.id for r in search.bm25(index, "closed", limit=0).collect()] == ["d"]
    assert search.preview("one\ntwo Café three", "cafe", around=2) == "two Café"


def test_ledger_views(spark):
    runs = spark.createDataFrame([("s", 1, None, "ok", 2, 1, 1, 0, 0, "x"), ("s", 2, "p", "failed", 3, 0, 2, 1, 0, ""), ("s", 3, "q", "ok", 0, 0, 0, 0, 0, "y")], "source_id string, run_ord int, parser string, status string, examined int, imported int, duplicate int, skipped int, failed int, notes string")
    row = ledger.sources(runs).first()
    assert (row.parser, row.status, row.examined, row.notes) == ("p", "ok", 5, "x\ny")
    listing = spark.createDataFrame([("a", "f1", "p", "1"), ("b", "f1", "p", "1")], "state_key string, fingerprint string, parser string, version string")
    state = spark.createDataFrame([("a", "f1", "p", "1", True, 1), ("b", "f0", "p", "1", True, 1)], "state_key string, fingerprint string, parser string, version string, complete boolean, run_ord int")
    assert [r.state_key for r in ledger.unfinished(listing, state).collect()] == ["b"]


def test_places_are_made_without_a_shuffle(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.choice("abcdefgé") for _ in range(rng.randint(0, 30))]) for k in range(50)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    want = {(i, t): [k for k, x in enumerate(ts) if x == t] for i, ts in rows for t in set(ts)}
    made = search.places(df)
    assert {(r.id, r.term): r.places for r in made.collect()} == want and made.count() == len(want)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    twice = search.places(df.unionByName(df.where("id < 3"))).collect()
    assert {(r.id, r.term): r.places for r in twice} == {k: sorted(v * (1 + (k[0] < 3))) for k, v in want.items()} and len(twice) == len(want)


def test_postings_are_written_by_tokens(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"one two {k}") for k in range(40)], "event_id long, text string")
    monkeypatch.setattr(search, "TASK_TOKENS", 30)
    search.write_index(docs, str(tmp_path / "index"))
    assert len(list((tmp_path / "index/postings").rglob("*.parquet"))) == 4  # of 120 tokens, in one bucket
    assert sorted(r.id for r in search.Index(spark, str(tmp_path / "index")).match("two").collect()) == list(range(40))
