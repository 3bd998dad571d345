"""Best-two-fit packing of tokenized documents into sequences.

A sequence is filled greedily with the longest piece that fits; where a gap is left, its
smallest piece goes back if two unpacked pieces fill the widened gap more tightly.

Only lengths matter to that, so the plan is made on the driver from the histogram of
lengths (at most `capacity` numbers, whatever the corpus): a filling is repeated as long
as every length in it lasts, which is what one-by-one packing would do. Each repeat uses up
a length, so the plan has a bounded number of fillings too. Pieces find their place by their rank among
pieces of their length; ranks are counted in two steps, so that a length that a third of
all pieces have isn't ranked in one task.

Cases: a null or empty text is the end id alone. Repeated rows are packed each. Null keys are
fine. An empty table has no pieces. Columns named like a result column are replaced.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, cut, quoted, slices, text_of, tokenizer_path, without
from .sharding import _ranked

CAPACITY = 4096
END_ID = 1
#: Parts kept in each of two generations.
KEEP_PARTS = 400_000
RESULT = ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repeats, lengths) of each filling, by best-two-fit."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left[length] += count
    sizes = np.arange(capacity + 1)
    out: list[tuple[int, list[int]]] = []
    while left.any():
        free = left.copy()
        longest = np.maximum.accumulate(np.where(free > 0, sizes, 0))
        filling: list[int] = []
        gap = capacity
        while gap:
            length = int(longest[gap])
            while length and not free[length]:
                length = int(longest[length - 1])
            if not length:
                break
            free[length] -= 1
            filling.append(length)
            gap -= length
        if gap and len(filling) > 1:
            smallest = filling[-1]
            room = gap + smallest
            longest = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            first = np.flatnonzero(free[: room + 1])
            second = longest[room - first]
            twice = (second == first) & (free[first] < 2)
            second[twice] = longest[np.maximum(first[twice] - 1, 0)]
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > smallest:
                k = int(total.argmax())
                filling[-1:] = [int(first[k]), int(second[k])]
        uses = Counter(filling)
        repeats = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= repeats * n
        out.append((repeats, filling))
    return out


def _places(fillings: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first rank), with that rank, first sequence and offset of each place."""
    seen: Counter = Counter()
    rows: list[tuple[int, int, int, int]] = []
    sequence = 0
    for repeats, filling in fillings:
        offset = 0
        for length in filling:
            rows.append((length << 48 | seen[length], seen[length], sequence, offset))
            seen[length] += repeats
            offset += length
        sequence += repeats
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
    return columns[0], columns[1], columns[2], columns[3]


#: Kinds of bytes: blanks and line ends, which part chunks; letters up to U+00FF; digits; ASCII marks but ' and <; all else. A chunk
#: of the first kinds alone is runs of letters, digits and runs of marks, which the vocabulary keeps apart, and its lower case is byte
#: by byte. An apostrophe may begin a part of its own, and < a special token.
_BLANK, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*b"'<"]] = _ODD
_KIND[[*b" \n"]] = _BLANK
_KIND[[*b"0123456789"]] = _DIGIT
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3, *range(0x80, 0xC0)]] = _LETTER  # other lead bytes are odd
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: What a vocabulary must do to texts first for the way by chunks to hold; others encode whole texts.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class _Parts:
    """Ids, as bytes, of the parts of texts, in two generations; the library encodes what is new."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            settings = json.load(f)
        self.known = settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER
        # for parts that are lower case and whole words already
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str], tokenizer: object) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, parts: list[bytes], odd: np.ndarray) -> list[bytes]:
        """Ids of different parts; odd: which of them the vocabulary must normalize and split."""
        if len(self.new) > KEEP_PARTS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = [k for k, p in enumerate(parts) if p not in new]
        new.update((parts[k], old[parts[k]]) for k in missing if parts[k] in old)
        for kind, tokenizer in ((False, self.bare), (True, self.tokenizer)):
            unknown = [parts[k] for k in missing if odd[k] == kind and parts[k] not in new]
            new.update(zip(unknown, self._encode([p.decode() for p in unknown], tokenizer)))
        return [new[p] for p in parts]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.known:
            return self._encode(texts, self.tokenizer)
        if len(texts) == 1 and len(texts[0]) > SLICE_BYTES:  # a long text in stretches that begin at blanks
            stops = [0]
            while (stop := texts[0].find(" ", stops[-1] + SLICE_BYTES)) > 0:
                stops.append(stop)
            return [b"".join(self._stretch([texts[0][a:b]])[0] for a, b in zip(stops, [*stops[1:], None]))]
        return self._stretch(texts)

    def _stretch(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        firsts = np.cumsum([0] + [len(r) + 1 for r in raw])
        data, kind, begins, sizes = _parts_of(b" ".join([*raw, b""]))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        every = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        code = every.indices.to_numpy(zero_copy_only=False)
        odd = np.zeros(len(every.dictionary), dtype=bool)
        odd[code[kind == _ODD]] = True
        ids = self._ids(every.dictionary.to_pylist(), odd)
        own = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        length = own[code]
        at = np.concatenate([[0], np.cumsum(length)])
        # every part's ids, from where those of its kind are
        places = np.arange(at[-1]) + np.repeat((np.cumsum(own) - own)[code] - at[:-1], length)
        out = np.frombuffer(b"".join(ids), dtype="<u4")[places]
        rows = at[np.searchsorted(begins, firsts)]
        return [out[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:])]


def _parts_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all parts, end to end, and each part's kind, place in `raw` and size; chunks that hold an odd sign are one part."""
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = _KIND[data]
    lower = _LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    signs = data[second]
    lower[second[(signs < 0x9F) & (signs != 0x97)]] += 32
    odd = np.concatenate([np.flatnonzero(kind == _ODD), second[(signs == 0x97) | (signs == 0xB7)]])  # the signs of times and division
    if len(odd):
        blanks = np.concatenate([[-1], np.flatnonzero(kind == _BLANK), [len(data)]])
        chunk = np.unique(np.searchsorted(blanks, odd))
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[blanks[chunk - 1] + 1] = 1
        step[blanks[chunk]] -= 1
        inside = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int8))
        kind[inside] = _ODD
        lower[inside] = data[inside]
    new = np.ones(len(data), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begins = np.flatnonzero(new)
    kinds, sizes = kind[begins], np.diff(np.append(begins, len(data)))
    some = kinds != _BLANK
    return lower[kind != _BLANK], kinds[some], begins[some], sizes[some]


_loaded: dict[str, _Parts] = {}


def chunk_ids(path: str, texts: list[str]) -> list[bytes]:
    """Ids (unsigned 32-bit, little-endian) of each text without special tokens.

    The vocabulary's tokens never hold a blank or line end, and what it does to a text before stops there too, so
    texts are cut there, plain chunks into their parts as well, and the library encodes each different one once.
    """
    if path not in _loaded:
        _loaded[path] = _Parts(path)
    return _loaded[path].encode(texts)


def forget(path: str) -> None:
    """Drop the parts that were kept for a task: the worker goes on to other operators, beside which they would take memory."""
    if path in _loaded:
        _loaded[path].new, _loaded[path].old = {}, {}


def tokenize(df: DataFrame, *, text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: df's columns but the text, with piece, start, length, ids_crc32 (and ids)."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    kept = without(df.drop(text_col), *RESULT, "ids", "__text")
    names = list(kept.columns)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())] + ([("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])
    schema = T.StructType([*kept.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            rows, out = [], {n: [] for n, _ in fields}
            for row, ids in enumerate(chunk_ids(path, part.column(part.num_columns - 1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), capacity * 4)):
                    own = ids[at : at + capacity * 4]
                    rows.append(row)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
                    if keep_ids:
                        out["ids"].append(np.frombuffer(own, dtype="<i4"))
            take = pa.array(rows, pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            new = [pa.array(out[n], k) for (n, _), k in zip(fields, kinds)]
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in part.columns[:-1]], *new], names=schema.names)
        forget(path)

    return df.select(*[quoted(c) for c in names], text_of(text_col).alias("__text")).mapInArrow(run, schema)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, bucket_rows: int = 200_000) -> DataFrame:
    """pieces (with a column length) with sequence_id and offset. pieces should be a table: it is read three times."""
    pieces = without(pieces, "sequence_id", "offset")
    names = list(pieces.columns)
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    total = sum(histogram.values())
    keys, firsts, sequences, offsets = _places(plan(histogram, capacity))
    order = F.xxhash64(*[quoted(c) for c in names])
    salted = pieces.withColumn("__order", order).withColumn("__salt", F.pmod("__order", F.lit(max(1, total // bucket_rows))))
    ranked = _ranked(salted, ["length"], ["__salt"], [F.col("__order")], "__rank").select(*[quoted(c) for c in names], "__rank")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequences[k] + rank - firsts[k]), pa.array(offsets[k])], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, *, text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack; the pieces are written once in between, without their ids."""
    return pack(cut(tokenize(df, text_col=text_col, tokenizer=tokenizer, capacity=capacity, end_id=end_id), "pieces"), capacity=capacity)
