"""Near duplicates by Order MinHash, verified by banded alignment.

Terms are runs of five words, labelled by their occurrence in the text. A sketch takes, under one
hash function, the two least labelled terms and keeps their order in the text, so two texts share it the likelier the
smaller their edit distance. Two sketches make a band; texts that share a band are candidates.

A candidate pair is a link if its aligned likeness is 0.8 or more: with c the longest common
subsequence of the two runs of terms, c / (n + m - c). The alignment is banded: as at most
n + m - 2c terms may be left out, cells further from the diagonal can't be on a path that is good enough.

Candidates are never all pairs of a band's group. Every member meets the group's least text first; linked texts make
classes, and in a second round only members of one group that are still in different classes
meet: all of them where the group is small, and those that share one of their rarest terms
(a text's rarest fifth and one more: two texts of likeness 0.8 can't avoid sharing one) where it is large. Rounds work on
distinct texts: copies share their text's class.

With 20 bands of two sketches a pair at 0.8 is missed with a probability of about 3e-5.

Cases: a null text is empty; texts without words are alike only if they are equal; texts under
five words have one term. Repeated rows share a class. Null ids take part; a class's id is its
least id (null if all are null). An empty table gives an empty result. Columns named
like a result column are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, row_key, slices, text_of, without
from .components import components
from .simhash import joined, mix, terms

LIKENESS = 0.8
WORDS = 5
BANDS = 20
ROWS = 2
#: Members of one group that may all meet in the second round; beyond it they meet by their rarest terms.
SMALL = 32
RESULT = ("class_id", "kept")
_ODD = np.random.default_rng(8_008).integers(1, 2**63, (256, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = np.uint64((1 << 22) - 1)


def labelled(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Terms' hashes that tell a term's occurrences in a text apart."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    occurrence = np.zeros(len(h), dtype=np.uint64)
    occurrence[order] = (np.arange(len(h)) - first).astype(np.uint64)
    again = occurrence > 0
    out = hashes.copy()
    out[again] = mix(hashes[again] + occurrence[again] * _ODD[0, 0])
    return out


def bands(hashes: np.ndarray, starts: np.ndarray, n_bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (texts x n_bands) of texts that all have a term."""
    label = labelled(hashes, starts)
    slot = np.arange(len(label), dtype=np.uint64)
    begin = starts[:-1]
    several = np.diff(starts) > 1
    out = np.empty((len(begin), n_bands), dtype=np.uint64)
    for band in range(n_bands):
        key = np.full(len(begin), band + 1, dtype=np.uint64)
        for row in range(rows):
            a, b = _ODD[(band * rows + row) % 256]
            v = (mix(label * a + b) & ~_SLOT) | slot
            one = (np.minimum.reduceat(v, begin) & _SLOT).astype(np.int64)
            v[one] = np.uint64(2**64 - 1)
            two = (np.minimum.reduceat(v, begin) & _SLOT).astype(np.int64)
            two = np.where(several, two, one)
            early, late = np.minimum(one, two), np.maximum(one, two)
            key = mix(key * _ODD[1, 0] + mix(label[early] * _ODD[2, 0] + label[late] * _ODD[3, 0]))
        out[:, band] = key
    return out


def runs_of(text: str, width: int = WORDS) -> list[tuple[str, ...]]:
    """The terms themselves, in order (words are parted by ASCII white space)."""
    word = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return [tuple(word)] if 0 < len(word) < width else list(zip(*(word[k:] for k in range(width))))


def aligned(a: list, b: list, least: float = LIKENESS) -> float:
    """c / (n + m - c) by an alignment within the band that `least` allows; 0 where it is below."""
    n, m = len(a), len(b)
    need = math.ceil((n + m) * least / (1 + least) - 1e-9)
    if not n or not m or min(n, m) < need:
        return float(a == b)
    if sum((Counter(a) & Counter(b)).values()) < need:
        return 0.0
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    common = head + tail
    if x and y:
        width = n + m - 2 * need
        places: dict = {}
        for i, s in enumerate(x):
            places[s] = places.get(s, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for j, s in enumerate(y):  # one row of the alignment in bits; only cells near the diagonal may match
            match = places.get(s)
            if match:
                low = max(0, j - width)
                match &= ((1 << (j + width + 1 - low)) - 1) << low
                use = row & match
                row = ((row + use) | (row - use)) & full
        common += len(x) - row.bit_count()
    return common / (n + m - common) if common >= need else 0.0


def sketched(texts: DataFrame, *, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, terms, bands) of each distinct text with a term, for texts(key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            hashes, starts = terms(*joined(part.column(1).to_pylist()), WORDS)
            some = np.flatnonzero(np.diff(starts) > 0)
            if len(some):
                keys = bands(hashes, np.append(starts[some], starts[-1]), n_bands, rows).view(np.int64)
                ends = pa.array(np.arange(0, keys.size + 1, n_bands), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(np.diff(starts)[some]), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], names=["key", "terms", "bands"])

    made = texts.select("key", "text").mapInArrow(run, "key binary, terms long, bands array<long>")
    return made.groupBy("key").agg(F.first("terms").alias("terms"), F.first("bands").alias("bands"))


def verified(pairs: DataFrame, texts: DataFrame, least: float = LIKENESS) -> DataFrame:
    """The pairs(a, b) whose aligned likeness is `least` or more, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, seen, out = None, [], []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last:
                    last, seen = a, runs_of(x)
                score = aligned(seen, runs_of(y), least)
                if score >= least:
                    out.append((a, b, score))
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.binary()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.float64())], names=["a", "b", "likeness"])

    left = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary, likeness double")


def find_links(docs: DataFrame, *, least: float = LIKENESS, n_bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, likeness) between distinct texts of docs(key, text) that make all classes, and (node, label)."""
    sketches = cut(sketched(docs, n_bands=n_bands, rows=rows), "sketches")
    member = sketches.select("key", "terms", F.explode("bands").alias("band"))
    groups = member.groupBy("band").agg(F.min("key").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1")
    grouped = cut(member.join(groups, "band"), "groups")
    wanted = grouped.select("key").distinct()
    texts = cut(docs.select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * least
    sizes = sketches.select(F.col("key").alias("center"), F.col("terms").alias("center_terms"))
    star = grouped.where("key != center").select(F.col("center"), "key", "terms").distinct().join(sizes, "center").where(fits(F.col("terms"), F.col("center_terms")))
    first = cut(verified(star.select(F.col("center").alias("a"), F.col("key").alias("b")), texts, least), "links")
    label = components(first)

    # second round: members of a group that are in different classes
    classed = grouped.join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = classed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    apart = cut(classed.join(mixed, "band").select("band", "key", "terms", "label", "center", "members"), "apart")
    few = apart.where(F.col("members") <= small)
    pairs = _meet(few.select("band", "key", "terms", "label", "center"), least)
    many = apart.where(F.col("members") > small)
    if many.limit(1).count():
        pairs = pairs.unionByName(_meet(_rarest(many, texts, least), least))
    tried = star.select(F.col("center").alias("a"), F.col("key").alias("b"))
    fresh = pairs.distinct().join(tried, ["a", "b"], "left_anti")
    second = cut(verified(fresh, texts, least), "links")
    links = first.unionByName(second)
    return links, (components(links) if second.limit(1).count() else label)


def _meet(rows: DataFrame, least: float) -> DataFrame:
    """Pairs a < b of rows(band, key, terms, label) of one band with different labels and fitting sizes."""
    x = rows.select("band", F.col("key").alias("a"), F.col("terms").alias("n"), F.col("label").alias("p"))
    y = rows.select("band", F.col("key").alias("b"), F.col("terms").alias("m"), F.col("label").alias("q"))
    return x.join(y, "band").where((F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & (F.least("n", "m") >= F.greatest("n", "m") * least)).select("a", "b")


def _rarest(many: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Members of large groups, grouped anew by each of their rarest terms (prefix filter): exact for `least`."""
    members = many.groupBy("key").agg(F.first("terms").alias("terms"), F.first("label").alias("label"), F.first("center").alias("center"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            hashes, starts = terms(*joined(part.column(1).to_pylist()), WORDS)
            label = labelled(hashes, starts) if len(hashes) else hashes
            ends = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(label.view(np.int64)))], names=["key", "labels"])

    listed = texts.join(members.select("key"), "key", "left_semi").select("key", "text").mapInArrow(run, "key binary, labels array<long>")
    term = cut(listed.select("key", F.explode("labels").alias("term")), "terms")
    often = term.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by_text = term.join(often, "term").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("all"))  # bounded by a text's own terms
    prefix = by_text.select("key", F.explode(F.slice("all", F.lit(1), F.size("all") - F.ceil(F.size("all") * least - 1e-9).cast("int") + 1)).alias("t"))
    return prefix.join(members, "key").select(F.col("t.term").alias("band"), "key", "terms", "label", "center")


def _labels(named: DataFrame, text_col: str, id_col: str, least: float) -> DataFrame:
    """(__key, id, label) of each distinct text: its least id and its class, for named(__key and df's columns)."""
    docs = named.select(F.col("__key").alias("key"), text_of(text_col).alias("text"))
    _, label = find_links(docs, least=least)
    ids = named.select("__key", quoted(id_col).alias("id"))
    return cut(ids.groupBy("__key").agg(F.min("id").alias("id")).join(label.withColumnRenamed("node", "__key"), "__key", "left").withColumn("label", F.coalesce("label", "__key")), "ids")


def classes(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least: float = LIKENESS) -> DataFrame:
    """df with class_id, the least id of the row's class, and kept, whether the row's id is that one."""
    rows = without(df, *RESULT)
    named = rows.withColumn("__key", row_key(text_of(text_col)))
    of = _labels(named, text_col, id_col, least)
    least_id = of.groupBy("label").agg(F.min("id").alias("class_id"))
    by_key = of.join(least_id, "label").select("__key", "class_id")
    return named.join(by_key, "__key").drop("__key").withColumn("kept", F.col("class_id").eqNullSafe(quoted(id_col)))


def deduplicated(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least: float = LIKENESS) -> DataFrame:
    """df with one row of each class: that of the least (id, text key), nulls last (any one of rows that share both)."""
    named = df.withColumn("__key", row_key(text_of(text_col)))
    of = _labels(named, text_col, id_col, least)
    first = of.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__key")).alias("first"))
    keep = first.select(F.col("first.__key").alias("__keep"), F.col("first.id").alias("__id"))
    # a text is in one class only, so its key stands for the class
    kept = named.join(keep, (F.col("__key") == F.col("__keep")) & quoted(id_col).eqNullSafe(F.col("__id")), "left_semi")
    return kept.dropDuplicates(["__key"]).drop("__key")
