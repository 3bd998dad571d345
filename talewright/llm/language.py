"""Language identification by the nearest centroid.

A text is a vector of hashed byte trigrams of its lower-cased letters, weighted by
(1 + log tf) * idf and normalised. Each language has a few centroids, clustered (spherical k-means)
from a bounded sample of labelled texts; a text gets the language of the centroid with the
largest cosine. It is rejected if that cosine lies further out than that of training texts of its length by a margin:
short texts lie far out by themselves, long ones don't.

Document frequencies count all labelled texts; only the centroids come from the sample: at most `sample_rows`
different texts divided by the number of languages from each, those of least hash.

Cases: a null text or one without a letter is `und` with score 0, and rejected; without any labelled
text all are `und`. A language with few texts gets as many centroids as it has texts. Null
languages are never learned. Repeated rows count as often as they occur. Columns named like a
result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import quoted, slices, text_of, with_arrow

SIZE = 4096
SAMPLE_ROWS = 4000
CLUSTERS = 4
#: A text is rejected below this share of the cosine that all but a thousandth of the sampled texts of its length or longer reach.
MARGIN = 0.6
#: Sampled texts (copies included) that a threshold needs; texts longer than all but as many have the one before.
LONGEST = 64
#: Trigrams of a text that is long enough for a threshold of its own length.
SHORT = 128
#: Texts whose counts are held at once.
ROWS = 256
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def by_rows(texts: list[str]) -> Iterator[list[str]]:
    """The texts, ROWS at a time: their dense counts are held at once."""
    for k in range(0, len(texts), ROWS):
        yield texts[k : k + ROWS]


def counts(texts: list[str]) -> np.ndarray:
    """Trigram counts (texts x SIZE); trigrams never cross texts."""
    raw = [b" " + t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    if len(data) < 3:
        return np.zeros((len(texts), SIZE), dtype=np.float32)
    sizes = np.array([len(r) for r in raw])
    row = np.repeat(np.arange(len(texts)), sizes)
    gram = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    slot = (gram * np.uint32(2_654_435_761)) >> np.uint32(20)
    inside = (row[2:] == row[:-2]) & (data[1:-1] != 32)
    flat = np.bincount(row[:-2][inside] * SIZE + slot[inside], minlength=len(texts) * SIZE)
    return flat.reshape(len(texts), SIZE).astype(np.float32)


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0).astype(np.float32) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """Centroids (rows) with their language, the idf, and the least cosines that aren't rejected from numbers of trigrams on."""

    languages: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    least: np.ndarray
    sizes: np.ndarray

    def score(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = vectors(count, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        return self.owner[best], np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, cosine and whether it is too far, for each text."""
        count = counts(texts)
        owner, score = self.score(count)
        return owner, score, self.too_far(count, score)

    def too_far(self, count: np.ndarray, score: np.ndarray) -> np.ndarray:
        size = count.sum(axis=1)
        step = np.searchsorted(self.sizes, size, side="right") - 1
        # a text of few trigrams meets a centroid in few of its places: cosines grow with the root of their number
        return score < self.least[np.maximum(step, 0)] * np.sqrt(np.minimum(size, SHORT) / SHORT)


def _reached(near: np.ndarray, copies: np.ndarray) -> float:
    """What all but a thousandth of the rows (texts times their copies) reach."""
    order = np.argsort(near)
    total = np.cumsum(copies[order])
    return near[order][np.searchsorted(total, total[-1] / 1000)]


def thresholds(near: np.ndarray, size: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, sizes): least cosines for texts of sizes[k] trigrams or more, sizes ascending from 0.

    Sizes are half octaves from SHORT on: texts of fewer trigrams, some twenty words, are held to what all texts reach, times the
    root of their share of SHORT. A longer text is never held to less than a shorter one.
    """
    least, sizes = [_reached(near, copies)], [0.0]
    for half in range(14, 64):
        own = size >= 2 ** (half / 2)
        if copies[own].sum() < LONGEST:
            break
        least.append(_reached(near[own], copies[own]))
        sizes.append(2 ** (half / 2))
    return np.maximum.accumulate(least) * MARGIN, np.array(sizes)


def _clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(15):
        nearest = (x @ centroids.T).argmax(axis=1)
        for c in range(k):
            own = x[nearest == c]
            if len(own):
                m = own.mean(axis=0)
                centroids[c] = m / max(np.linalg.norm(m), 1e-9)
    return centroids


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS, clusters: int = CLUSTERS, seed: int = 5) -> Model:
    """The model of all rows with a language and a letter."""
    rows = labelled.select(quoted(id_col).alias("id"), quoted(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text")).where(F.col("lang").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text", F.lit(seed)))
    # different texts with a letter, for the sample's share alone
    number = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct(F.when(has_letter(F.col("text")), F.col("h")))).collect()}
    languages = sorted(number)
    if not languages:
        return Model([], np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64), np.ones(SIZE, np.float32), np.zeros(1), np.zeros(1))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for part in slices(batches, "text"):
            for texts in by_rows(part.column(0).to_pylist()):
                total += (counts(texts) > 0).sum(axis=0)
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SIZE, dtype=np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
            n += sum(b.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["df", "n"])

    parts = rows.select("text").mapInArrow(frequencies, "df binary, n long").repartition(16).mapInArrow(added, "df binary, n long").collect()
    n = sum(r.n for r in parts)
    df = sum((np.frombuffer(r.df, dtype=np.int64) for r in parts), np.zeros(SIZE, dtype=np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)

    # a sample by the text's hash, twice as large as wanted, then the least hashes of each language: copies count once
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(x) for k, v in number.items() for x in (k, min(1.0, 2 * each / max(1, v)))])
    some = rows.where((F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)) & has_letter(F.col("text")))
    different = some.groupBy("lang", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    chosen = different.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            for k in range(0, part.num_rows, ROWS):
                c = counts(part.column(1).slice(k, ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(k, ROWS), part.column(2).slice(k, ROWS), pa.array([r.tobytes() for r in c], pa.binary())], names=["lang", "n", "x"])

    sample = chosen.orderBy("lang", "k").select("lang", "text", "n").mapInArrow(features, "lang string, n long, x binary").collect()
    x = {k: [] for k in languages}
    weight = {k: [] for k in languages}
    for r in sample:
        x[r.lang].append(np.frombuffer(r.x, dtype=np.float32))
        weight[r.lang].append(r.n)
    centroids, owner, near, size, copies = [], [], [], [], []
    for i, k in enumerate(languages):
        if x[k]:
            own = np.vstack(x[k])
            v = vectors(own, idf)
            c = _clusters(v, clusters, seed)
            near.append((v @ c.T).max(axis=1))
            size.append(own.sum(axis=1))
            copies.append(weight[k])
            centroids.append(c)
            owner += [i] * len(c)
    if not centroids:
        return Model([], np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64), idf, np.zeros(1), np.zeros(1))
    return Model(languages, np.vstack(centroids), np.array(owner), idf, *thresholds(np.concatenate(near), np.concatenate(size), np.concatenate(copies)))


def predict(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (cosine with the nearest centroid) and rejected."""
    languages = model.languages

    def work(texts: pa.Array) -> list[pa.Array]:
        import regex

        listed = texts.to_pylist()
        readable = np.array([bool(languages) and regex.search(r"\p{L}", t) is not None for t in listed])
        if not languages:
            return [pa.array(["und"] * len(listed)), pa.array([0.0] * len(listed)), pa.array([True] * len(listed))]
        owner, score, far = (np.concatenate(x) for x in zip(*map(model.judge, by_rows(listed))))
        names = [languages[o] if r else "und" for o, r in zip(owner, readable)]
        rejected = ~readable | far
        return [pa.array(names, pa.string()), pa.array(np.where(readable, score, 0.0)), pa.array(rejected)]

    return with_arrow(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())], work)
