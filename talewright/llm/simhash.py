"""SimHash fingerprints and the search for near ones.

Terms are runs of five words (a shorter text is one term), weighted by how often they occur.
Each term's 64-bit hash is stretched to the fingerprint's bits, which vote up or down by it; the
signs of the sums are the fingerprint. The likeness of two fingerprints is the share of equal bits.

The search cuts fingerprints into blocks; whatever differs in at most `radius` bits agrees in all but `radius` of
them, so a table for each choice of agreeing blocks, keyed by those blocks brought to the front (the
permutation), finds every pair. A block key that very many fingerprints share is joined like any
other, but split by salt.

Cases: null is an empty text; a text without words has a fingerprint of zeros; equal texts
have equal fingerprints; repeated rows each get theirs; an empty table gives an empty result.
Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, slices, text_of, with_arrow, without

WORDS = 5
BITS = 256
#: Bits in which near fingerprints may differ.
RADIUS = 8
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20_240_607)
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STRETCH = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts laid end to end, and each text's first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    gap = _SPACE[data]
    begins = np.empty(n, dtype=bool)
    begins[0] = True
    begins[1:] = gap[:-1]
    inner = ends[1:-1]
    begins[inner[inner < n]] = True
    begins &= ~gap
    first = np.flatnonzero(begins)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    value = _LETTER[data]
    value[gap] = 0
    own = np.repeat(first, np.diff(np.append(first, n)))
    place = np.arange(first[0], n) - own
    value[first[0] :] *= _POWER[place & 4095]
    hashes = mix(np.add.reduceat(value, first))
    return hashes, np.searchsorted(first, ends)


def terms(data: np.ndarray, ends: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, and each text's first term (one more at the end)."""
    word, first = words(data, ends)
    count = np.diff(first)
    runs = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(runs)])
    if not len(word):
        return word, starts
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first[:-1], runs)
    last = np.repeat(first[1:], runs)
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        j = at + k
        inside = j < last
        out += np.where(inside, word[np.minimum(j, len(word) - 1)] * _ORDER[k % WORDS], np.uint64(0))
    return mix(out), starts


def fingerprints(data: np.ndarray, ends: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Fingerprints (rows of bits / 8 bytes) of texts laid end to end."""
    hashes, starts = terms(data, ends)
    n = len(starts) - 1
    votes = np.zeros((n, bits), dtype=np.int64)
    weight = np.diff(starts)
    block = 32_768
    text_of_term = np.repeat(np.arange(n), weight)
    for a in range(0, len(hashes), block):
        h = hashes[a : a + block]
        wide = np.empty((len(h), bits // 64), dtype=np.uint64)
        for k in range(bits // 64):
            wide[:, k] = mix(h * _STRETCH[k])
        lanes = np.unpackbits(wide.view(np.uint8), axis=1).view(np.uint64)  # eight one-byte counters each
        owner = text_of_term[a : a + block]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        # a counter holds up to 255: longer stretches are cut
        pieces = np.unique(np.concatenate([cuts, *[np.arange(c, d, 255) for c, d in zip(cuts, np.append(cuts[1:], len(h))) if d - c > 255]]).astype(np.int64))
        sums = np.add.reduceat(lanes, pieces, axis=0).view(np.uint8)
        np.add.at(votes, owner[pieces], sums)
    return np.packbits((votes * 2 > weight[:, None]), axis=1)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts end to end, and their ends (0 first)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def of_texts(texts: list[str], bits: int = BITS) -> np.ndarray:
    return fingerprints(*joined(texts), bits)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits, row by row."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / (a.shape[1] * 8)


def fingerprint(df: DataFrame, *, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """df with `fingerprint`, lowercase hex."""

    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([r.tobytes().hex() for r in of_texts(texts.to_pylist(), bits)], pa.string())]

    return with_arrow(df, text_col, [T.StructField("fingerprint", T.StringType())], work)


def near(prints: DataFrame, *, radius: int = RADIUS, bits: int = BITS, blocks: int | None = None, salts: int = 8) -> DataFrame:
    """All pairs (a < b, distance <= radius) of distinct fingerprints in `fingerprint`, none missed.

    Copies are one fingerprint here: join the pairs to the rows to get theirs. `blocks` (radius + 1 at least)
    trades tables against shorter keys. The radius of 8 in 256 bits stands for texts that share some 99 of 100 terms; likeness
    0.8 lies at about 39 bits, where no table of blocks parts a corpus, and is the business of the near-duplicate classes.
    """
    blocks = blocks or radius + 1
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    own = prints.select("fingerprint").where("fingerprint is not null").distinct()
    digits = bits // 4
    cuts = [digits * k // blocks for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), blocks - radius))
    keys = F.array(*[F.concat_ws("|", F.lit(str(n)), *[F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in c]) for n, c in enumerate(choices)])
    table = own.select("fingerprint", F.explode(keys).alias("key"))
    # most keys are had by one fingerprint: they are counted alone and go
    often = table.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    table = cut(table.join(often, "key", "left_semi"), "block-keys")
    left = table.select(F.col("fingerprint").alias("a"), "key", F.pmod(F.xxhash64("fingerprint"), F.lit(salts)).alias("salt"))
    right = table.select(F.col("fingerprint").alias("b"), "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    pieces = [(F.conv(F.substring("a", k + 1, 8), 16, 10).cast("long"), F.conv(F.substring("b", k + 1, 8), 16, 10).cast("long")) for k in range(0, digits, 8)]
    distance = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in pieces), F.lit(0))
    return left.join(right, ["key", "salt"]).where(F.col("a") < F.col("b")).select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def with_edits(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", bits: int = BITS, bound: int = 4000) -> DataFrame:
    """Each row's id with n_chars, the text edited by the next row's (ascending id, then text; after the last the first), and both fingerprints.

    Rows are cut into ranges of ids at approximate quantiles. The first row of each range goes to the range before as well,
    so every row meets its successor without a global sort, and the texts move once.
    """
    spark = df.sparkSession
    rows = df.select(quoted(id_col).cast("long").alias("__id"), text_of(text_col).alias("__text"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(bound, count * 4))
    ids = df.select(quoted(id_col).cast("long").alias("__id"))
    got = ids.agg(F.percentile_approx("__id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    bounds = sorted(set(got)) if n > 1 else []
    steps = max(1, len(bounds)).bit_length()
    listed = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.expr("cast(array() as array<bigint>)")
    # binary search for the number of bounds that are not above the id; null ids come first
    halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(
        F.get(listed, F.expr("0") + ((s["lo"] + s["hi"]) / 2).cast("int")) <= F.col("__id"),
        F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")),
    ).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))
    found = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve)["lo"]
    bucket = F.when(F.col("__id").isNull(), F.lit(0)).otherwise(found)
    heads = sorted((b, i) for b, i, _ in ids.select(bucket.alias("b"), "__id").groupBy("b").agg(F.min(F.struct(F.col("__id").isNotNull().alias("k"), "__id"))["__id"].alias("i"), F.count(F.lit(1))).collect())
    placed = rows.withColumn("bucket", bucket).withColumn("foreign", F.lit(False))
    extra = rows.limit(0).withColumn("bucket", F.lit(0)).withColumn("foreign", F.lit(True))
    if heads:
        before = {i: heads[k - 1][0] for k, (_, i) in enumerate(heads)}
        known = {i: b for i, b in before.items() if i is not None}
        to = F.create_map(*[F.lit(x) for i, b in known.items() for x in (i, b)]) if known else None
        parts = []
        if known:
            parts.append(rows.where(F.col("__id").isin(list(known))).withColumn("bucket", F.element_at(to, F.col("__id"))))
        if None in before:
            parts.append(rows.where(F.col("__id").isNull()).withColumn("bucket", F.lit(before[None])))
        for p in parts:
            p = p.groupBy("__id", "bucket").agg(F.min("__text").alias("__text")).select("__id", "__text", "bucket")  # the first of several
            extra = extra.unionByName(p.withColumn("foreign", F.lit(True)))
    together = placed.unionByName(extra.select(placed.columns)).repartition("bucket").sortWithinPartitions("bucket", "foreign", "__id", "__text")
    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row, still without its successor
        for part in slices(batches, "__text", 2 << 20):
            d = part.to_pydict()
            rows = held + list(zip(d["bucket"], d["foreign"], d["__id"], d["__text"]))
            held = rows[-1:]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            if not pairs:
                continue
            halves = [len(a[3]) // 2 for a, _ in pairs]
            edited = [a[3][: len(a[3]) - h] + b[3][:h] for (a, b), h in zip(pairs, halves)]
            own, after, changed = of_texts([a[3] for a, _ in pairs], bits), of_texts([b[3] for _, b in pairs[-1:]], bits), of_texts(edited, bits)
            following = np.vstack([own[1:], after])
            for k in [k for k in range(len(pairs) - 1) if pairs[k][1] is not pairs[k + 1][0]]:
                following[k] = of_texts([pairs[k][1][3]], bits)[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[2] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array([r.tobytes().hex() for r in own], pa.string()),
                    pa.array([r.tobytes().hex() for r in changed], pa.string()),
                    pa.array(likeness(own, changed)),
                    pa.array(likeness(own, following)),
                ],
                names=names,
            )

    return together.mapInArrow(run, schema)
