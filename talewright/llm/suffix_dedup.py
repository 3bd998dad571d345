"""Removal of every byte that lies in a repeated string of `length` bytes, by suffix sorting.

Repeats are judged on the input: a string counts if it starts anywhere else too, in another
document or the same one, overlapping or not; no string crosses documents.

How the suffixes are spread: each window of `length` bytes is sent by its anchor, the
64-byte string in it with the least hash (the leftmost of several). Equal windows have equal anchors
at the same place, so they meet. Neighbouring windows share their anchor, and travel as one stretch
of bytes.

1. Anchors that occur once are dropped: counts are added up before they are shuffled, and then joined to the
   anchors, where adaptive execution splits a hot one.
2. A stretch that occurs twice as a whole is settled by its 128-bit digest: all of it repeats, and one copy stands for it.
   Only stretches that differ from all others of their anchor are sorted, against one copy of each other stretch.
3. Suffixes of an anchor are sorted deep-shallow: multikey quicksort by 8-byte signs (below, equal to and above a pivot; only
   the equal part goes deeper) to a shallow depth, all groups of a batch at once; groups that still agree go into blind tries, which
   give their order and common prefixes. A common prefix of `length` bytes is a repeat.
4. An anchor with more than `hot` different stretches (a boilerplate line between texts that all differ) isn't
   gathered in a task: its windows are parted by a deeper string. Each has at least half of the bytes outside the anchor either
   behind or before it; with those the anchor is longer, and equal windows still meet. Stretches that are equal then are settled,
   byte by byte; what is still hot is parted again, until the anchor is the whole window. The rest goes to the same sorter.

Cases: a null or empty text, or one under `length` bytes, loses nothing. Repeated rows are repeats of each other. Very
long texts are anchored in segments, which may split a stretch but no window. An empty table gives an empty result.
Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, quoted, row_key, slices, text_of, without
from .simhash import mix

LENGTH = 200
ANCHOR = 64
SHALLOW = 64
HOT = 2000
SEGMENT = 1 << 20
RESULT = ("n_bytes", "spans", "kept")
_SIGN = np.random.default_rng(64_200).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.random.default_rng(200_64).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 21) - 1)


def _anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on, by doubling."""
    h = _SIGN[data]
    width = 1
    for step in _STEP:
        if width == ANCHOR:
            break
        h = h[:-width] * step + h[width:]
        width *= 2
    return mix(h)


def stretches(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: start, number of windows, anchor's hash and anchor's place of each stretch."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes = _anchor_hashes(data)
    least = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, want = 1, length - ANCHOR + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = (least & _PLACE).astype(np.int64)
    inside = np.ones(len(place), dtype=bool)
    for e in ends[1:-1]:
        inside[max(0, e - length + 1) : e] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    at = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(first, len(starts)))
    return starts[first], count, hashes[at[first]], at[first]


def _packed(start: np.ndarray, windows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A stretch's start in its text, its number of windows and its anchor's place in it (both at most LENGTH - ANCHOR + 1) as one number."""
    return (start << 16) | (windows << 8) | place


def _rows(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[list[np.ndarray], ...]:
    """Row, start, windows and anchor's place (packed), anchor and digest (two halves) of each stretch; long texts go by segments."""
    out: tuple[list, ...] = ([], [], [], [])
    if len(ends) == 2 and len(data) > SEGMENT + length:
        pieces = [(a, data[a : a + SEGMENT + length - 1], np.array([0, min(SEGMENT + length - 1, len(data) - a)])) for a in range(0, len(data), SEGMENT)]
    else:
        pieces = [(0, data, ends)]
    for base, part, stops in pieces:
        start, count, anchor, place = stretches(part, stops, length)
        if not len(start):
            continue
        view = memoryview(np.ascontiguousarray(part))
        digest = xxhash.xxh3_128_digest
        digests = b"".join([digest(view[a:b]) for a, b in zip(start.tolist(), (start + count - 1 + length).tolist())])
        row = np.searchsorted(stops, start, side="right") - 1
        for o, x in zip(out, (row, _packed(start - stops[row] + base, count, place - start), anchor.view(np.int64), np.frombuffer(digests, dtype=np.int64).reshape(-1, 2))):
            o.append(x)
    return out


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and their ends (0 first)."""
    col = pa.concat_arrays([col])
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    ends = np.frombuffer(col.buffers()[1], dtype=kind, count=col.offset + len(col) + 1)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


class _Trie:
    """A blind trie of byte strings of one length: nodes know a depth and the strings below by the byte there."""

    __slots__ = ("root", "length")

    def __init__(self, length: int):
        self.root: tuple | None = None
        self.length = length

    def add(self, text: bytes, value: int) -> None:
        number = int.from_bytes(text, "big")
        if self.root is None:
            self.root = (self.length, text, number, [value])
            return
        node = self.root
        while type(node) is list:  # blind: only the branching bytes are looked at
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        differ = node[2] ^ number
        if not differ:
            node[3].append(value)
            return
        depth = self.length - (differ.bit_length() + 7) // 8
        leaf = (self.length, text, number, [value])
        parent, node = None, self.root
        while type(node) is list and node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        if type(node) is list and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        other = node
        while type(other) is list:
            other = next(iter(other[1].values()))
        branch = [depth, {other[1][depth]: node, text[depth]: leaf}]
        if parent is None:
            self.root = branch
        else:
            parent[1][text[parent[0]]] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """The values in the order of their strings, and the bytes that each string has in common with the one before."""
        values, common = [], []
        stack = [(0, self.root)]
        while stack:
            shared, node = stack.pop()
            if type(node) is list:
                children = [node[1][k] for k in sorted(node[1])]
                stack += [(node[0], c) for c in reversed(children[1:])]
                stack.append((shared, children[0]))
            else:
                values += node[3]
                common += [shared] + [self.length] * (len(node[3]) - 1)
        return values, common


def _runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal ids."""
    first = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    return first, np.diff(np.append(first, len(sorted_ids)))


def _quicksort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Multikey quicksort of the suffixes of each group to a shallow depth: the order, and (first place, size) of the groups that still agree.

    All segments of the order are worked on at once. A segment is parted by a pivot, the median of three signs of 8 bytes, into
    what lies below, what has that sign and what lies above; only the middle part goes on to the next sign.
    """
    order = np.argsort(group, kind="stable")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at, depth, deep = np.arange(len(order)), np.zeros(len(order), dtype=np.int64), []
    segment = group[order]
    while len(at):
        first, size = _runs(segment)
        many = np.repeat(size > 1, size)  # a suffix by itself is in its place
        done = many & (depth >= shallow)
        if done.any():
            f, n = _runs(segment[done])
            deep.append((at[done][f], n))
            many &= ~done
        at, depth, segment = at[many], depth[many], segment[many]
        if not len(at):
            break
        first, size = _runs(segment)
        where = starts[order[at]] + depth
        sign = np.zeros(len(at), dtype=np.uint64)
        for k in range(8):
            sign = (sign << np.uint64(8)) | padded[where + k].astype(np.uint64)
        three = np.sort(np.stack([sign[first], sign[first + size // 2], sign[first + size - 1]]), axis=0)
        pivot = np.repeat(three[1], size)
        part = (sign >= pivot).astype(np.int64) + (sign > pivot)
        key = np.repeat(np.arange(len(first)) * 3, size) + part
        ends = np.cumsum(np.bincount(key, minlength=3 * len(first)))
        to = np.empty(len(at), dtype=np.int64)
        for p in range(3):  # stable within each part
            own = np.flatnonzero(part == p)
            if len(own):
                f, n = _runs(key[own])
                to[own] = np.arange(len(own)) + np.repeat(ends[key[own][f]] - n - f, n)
        moved, segment, deeper = np.empty_like(at), np.empty_like(key), np.empty_like(depth)
        moved[to], segment[to], deeper[to] = order[at], key, depth + 8 * (part == 1)
        order[at], depth = moved, deeper
    return order, deep


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Deep-shallow sorting of suffixes by group and their first `length` bytes.

    Gives the order and how many bytes each suffix has in common with the one before in its group, where those are
    `shallow` or more, else 0.
    """
    order, deep = _quicksort(data, starts, group, shallow)
    common = np.zeros(len(order), dtype=np.int64)
    whole = data.tobytes()
    for first, size in deep:
        two = first[size == 2]  # a trie of two leaves is one comparison
        for k in range(0, len(two), 8192):
            at = two[k : k + 8192]
            reach = np.arange(shallow, length)
            a, b = (data[starts[order[x]][:, None] + reach] for x in (at, at + 1))
            differ = a != b
            place = differ.argmax(axis=1)
            equal = ~differ[np.arange(len(at)), place]
            common[at + 1] = np.where(equal, length, shallow + place)
            swap = at[~equal & (a[np.arange(len(at)), place] > b[np.arange(len(at)), place])]
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            trie = _Trie(length)
            for i in order[f : f + n].tolist():
                s = starts[i]
                trie.add(whole[s : s + length], i)
            order[f : f + n], shared = trie.walk()
            common[f + 1 : f + n] = shared[1:]
    return order, common


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """Which of the suffixes agree in `length` bytes with another of their group: those with a neighbour that does."""
    order, common = sorted_suffixes(data, starts, group, length, shallow)
    found = np.zeros(len(starts), dtype=bool)
    same = np.flatnonzero(common >= length)
    found[order[same]] = found[order[same - 1]] = True
    return found


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of set flags."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_SPAN = "key binary, start long, stop long"


def _sort_stretches(length: int, budget: int = 8 << 20):
    """mapInArrow over stretches sorted by anchor -> spans of those that occur once."""

    def work(rows: list[tuple]) -> tuple[list, list, list]:
        data = np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[1]) for r in rows])
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(rows)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
        # equal windows have their anchor at the same place: groups are anchors by that place
        place = np.array([r[5] for r in rows])
        anchor = np.unique(np.array([r[0] for r in rows], dtype=np.int64), return_inverse=True)[1]
        group = anchor[owner] * 512 + (place[owner] - offset)
        flags = repeated(data, base[owner] + offset, group, length)
        keys, starts, stops = [], [], []
        first = np.concatenate([[0], np.cumsum(windows)])
        for k, r in enumerate(rows):
            if r[2] == 1:
                for a, b in zip(*_spans(flags[first[k] : first[k + 1]])):
                    keys.append(r[3])
                    starts.append(r[4] + int(a))
                    stops.append(r[4] + int(b) + length)
        return keys, starts, stops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                keys, starts, stops = work(rows)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["key", "start", "stop"])

        for batch in batches:
            d = batch.to_pydict()
            for r in zip(d["anchor"], d["stretch"], d["copies"], d["key"], d["start"], d["place"]):
                if size > budget and held[-1][0] != r[0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[1]) * 24
        yield from flush(held)

    return run


_PART_ROW = "anchor long, core int, place int, stretch binary, copies long, key binary, start long"
_STRETCH_ROW = _PART_ROW + ", kinds long"  # kinds: how many different stretches the anchor has


def _stretch_batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    arrow = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def deeper(anchor: int, core: int, place: int, stretch: bytes, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(anchor, core, place, start, stretch) of a stretch's windows, parted by which longer string around the anchor they hold.

    Windows that have half of the other bytes behind the core take those to it; the others, which have more before it, take those.
    """
    rest = length - core
    behind = -(-rest // 2)
    before = rest - behind + 1
    windows = len(stretch) - length + 1
    split = max(0, place - (rest - behind))  # the first window with `behind` bytes after the core
    for first, last, side, low, high in ((split, windows, b"b", place, place + core + behind), (0, min(split, windows), b"a", place - before, place + core)):
        if first < last:
            own = xxhash.xxh3_64_intdigest(side + anchor.to_bytes(8, "little", signed=True) + stretch[low:high])
            yield own - 2**64 if own >= 2**63 else own, high - low, low - first, first, stretch[first : last - 1 + length]


def _resolve(stretch: DataFrame, length: int, hot: int) -> DataFrame:
    """Spans of the stretches (see _STRETCH_ROW) that occur once and repeat in part; a hot anchor's are parted until it is cold."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.to_pydict()
            out: list[tuple] = []
            for anchor, core, place, raw, copies, key, start in zip(*(d[f.split()[0]] for f in _PART_ROW.split(", "))):
                out += [(a, c, p, s, copies, key, start + at) for a, c, p, at, s in deeper(anchor, core, place, raw, length)]
                if len(out) >= 10_000:
                    yield _stretch_batch(out, _PART_ROW)
                    out = []
            if out:
                yield _stretch_batch(out, _PART_ROW)

    whole = lambda df: df.select("key", "start", (F.col("start") + F.octet_length("stretch")).alias("stop"))
    spans = None
    while True:
        cold = stretch.where(F.col("kinds") <= hot).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sort_stretches(length), _SPAN)
        spans = cold if spans is None else spans.unionByName(cold)
        too_many = stretch.where(F.col("kinds") > hot)
        if too_many.isEmpty():
            return spans
        parts = cut(too_many.mapInArrow(part, _PART_ROW), "parts")
        # equal ones are settled; one of each goes on, unless it is its anchor's only one or all of its anchor's are settled
        kinds = parts.groupBy("anchor", "core", "place", "stretch").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start")).alias("one"))
        kinds = cut(kinds.select("anchor", "core", "place", "stretch", "copies", "one.key", "one.start"), "kinds")
        settled = parts.where("copies = 1").join(kinds.where("copies > 1").select("anchor", "place", "stretch"), ["anchor", "place", "stretch"], "left_semi")
        spans = spans.unionByName(whole(settled))
        of_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).where("kinds > 1 and single > 0")
        stretch = cut(kinds.join(of_anchor.drop("single"), "anchor").select(*[f.split()[0] for f in _STRETCH_ROW.split(", ")]), "bytes")


def find_repeats(docs: DataFrame, *, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(key, start, stop) of repeated stretches in docs(key binary, text string); spans may overlap."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SEGMENT):
            rows = _rows(*_bytes(part.column(1)), length)
            if not rows[0]:
                continue
            row, at, anchor, digest = (np.concatenate(x) for x in rows)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at), pa.array(anchor), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["key", "at", "anchor", "digest", "digest2"])

    found = docs.select("key", "text").where(F.octet_length("text") >= length).mapInArrow(anchors, "key binary, at long, anchor long, digest long, digest2 long")
    often = found.select("anchor").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    shared = cut(found.join(often.hint("shuffle_hash"), "anchor"), "anchors")

    equal = ["anchor", "digest", "digest2"]
    kinds = shared.groupBy(*equal).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("key", "at")).alias("one"))
    kinds = cut(kinds.select(*equal, "copies", "one.key", "one.at"), "stretches")
    of_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("copies") == 1).alias("single")).where("kinds > 1 and single > 0")
    settled = shared.join(kinds.where("copies > 1").select(*equal), equal, "left_semi")
    start, windows = F.expr("at div 65536"), F.expr("at div 256 % 256")
    whole = settled.select("key", start.alias("start"), (start + windows - 1 + length).alias("stop"))

    wanted = kinds.join(of_anchor.drop("single"), "anchor")
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "copies", "at", "kinds")).alias("wanted"))
    texts = docs.join(lists.hint("shuffle_hash"), "key")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, listed in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("key", "text", "wanted"))):
                raw = text.encode()
                for w in listed:
                    a, n, place = w["at"] >> 16, w["at"] >> 8 & 255, w["at"] & 255
                    out.append((w["anchor"], ANCHOR, place, raw[a : a + n - 1 + length], w["copies"], key, a, w["kinds"]))
            for k in range(0, len(out), 10_000):
                yield _stretch_batch(out[k : k + 10_000], _STRETCH_ROW)

    stretch = cut(texts.select("key", "text", "wanted").mapInArrow(take, _STRETCH_ROW), "bytes")
    return whole.unionByName(_resolve(stretch, length, hot))


def _narrowed(raw: bytes, start: int, stop: int) -> list[int]:
    """The span without parts of characters at its ends."""
    while start < stop and raw[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(raw) and raw[stop] & 0xC0 == 0x80:
        stop -= 1
    return [start, stop]


def remove_repeats(df: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """df's columns but the text, with n_bytes, spans (array of start and stop, maximal removed runs) and kept (the other bytes).

    whole_characters: spans are narrowed to whole UTF-8 characters, so that what is kept is text.
    """
    names = without(df.drop(text_col), *RESULT).columns
    docs = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)], row_key(quoted(id_col), text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    spans = find_repeats(docs, length=length, hot=hot)
    by_key = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    both = docs.join(by_key.hint("shuffle_hash"), "key", "left").drop("key")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
    kept_fields = [T.StructField(f"c{i}", df.schema[n].dataType) for i, n in enumerate(names)]
    schema = T.StructType([*kept_fields, T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sizes, lists, kept = [], [], []
            for text, found in zip(part.column(width).to_pylist(), part.column(width + 1).to_pylist()):
                raw = text.encode()
                merged: list[list[int]] = []
                for f in sorted((f["start"], f["stop"]) for f in found or ()):
                    if merged and f[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], f[1])
                    else:
                        merged.append([*f])
                if whole_characters:
                    merged = [m for m in (_narrowed(raw, *m) for m in merged) if m[0] < m[1]]
                cuts = [0, *[x for m in merged for x in m], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                sizes.append(len(raw))
                lists.append([{"start": a, "stop": b} for a, b in merged])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(sizes, pa.int64()), pa.array(lists, kind), pa.array(kept, pa.binary())], names=schema.names)

    done = both.mapInArrow(run, schema)
    return done.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *RESULT)
