"""The corpus pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

import collections

import pytest

pytest.importorskip("talewright.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402
from test_llm import base_by_force, classes_by_force, removed_by_force  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    first = stages["quality rules"](spark, docs, sf).cache()
    assert first.columns == columns
    kept = {r.doc_id for r in first.collect()}
    for r in docs.collect():
        b = base_by_force(r.text or "")
        if b[0] < 10 or 100 * b[4] > 20 * b[0]:
            assert r.doc_id not in kept

    second = stages["language ID"](spark, first, sf).cache()
    assert second.columns == columns and {r.doc_id for r in second.collect()} == kept

    third = stages["near duplicates"](spark, second, sf).cache()
    classes = classes_by_force([(r.doc_id, r.text) for r in second.collect()])
    assert third.columns == columns and {r.doc_id for r in third.collect()} == {i for i, c in classes.items() if i == c}

    fourth = stages["repeated passages"](spark, third, sf).cache()
    before = third.orderBy("doc_id").collect()
    want = removed_by_force([r.text.encode() for r in before], 200)
    after = {r.doc_id: r for r in fourth.collect()}
    assert fourth.columns == columns and len(after) == len(before)
    for r, (left, gone, spans) in zip(before, want):
        assert 0 <= len(after[r.doc_id].text.encode()) - len(left) <= 6 * spans and after[r.doc_id].n_chars == len(after[r.doc_id].text)

    last = stages["packing"](spark, fourth, sf).collect()
    assert collections.Counter(r.doc_id for r in last if r.piece == 0) == collections.Counter(list(after))


def test_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_stages_on_awkward_rows(spark, sf):
    """Nulls in every column, repeated ids and rows, a very long text and columns named like what stages make."""
    good = "The old boat drifted slowly past the quiet harbour while gulls circled above it.\nNobody on the pier had seen it leave in the morning. "
    rows = [(None, None, None, None, None), (None, good, "en", None, 5), (1, good, None, "a", None), (1, good, None, "a", None), (1, "Another text of more than ten words stands here under the same number as others do.", "en", "a", 3), (2, "", "en", "a", 0), (3, " ".join(f"word{k}" for k in range(20_000)) + ".", "en", "b", 1)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = base
    for name in ("class_id", "kept", "spans", "lang_pred", "rejected", "clean_text", "key", "label", "found", "digest"):
        docs = docs.withColumn(name, F.lit("clash"))
    docs = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns and len(got) <= len(rows), name
        assert all(r.kept == "clash" for r in got), name
    assert len({(r.doc_id, r.piece) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}) > 4
    chained = docs
    for _, stage in corpus_pipeline.STAGES:
        chained = stage(spark, chained, sf)
    assert chained.count() >= 1
