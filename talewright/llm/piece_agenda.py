"""Encoding and decoding with a merge-type piece vocabulary (a .model file).

The encoder keeps an agenda of adjacent symbol pairs ordered by score (leftmost first among
equals) and merges the best until none is left. Texts are cut before each run of the blank sign that
follows another sign: where no piece crosses such a place, neither does a merge, so segments
are encoded by themselves and kept in a bounded table. All new segments of each Arrow batch are
encoded and decoded by the sentencepiece library as well, in runs, and one whole text of the batch is; a difference ends the job.

Cases: a null or empty text has no ids and decodes to ''. A text that is one long
word is one agenda of its length (n log n). Columns named `ids` or `decoded` are replaced; rows
are neither merged nor dropped.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import tokenizer_path, with_arrow
from .merge_table import MergeTable

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Segments kept in each of two generations, and their longest.
KEEP_SEGMENTS = 200_000
KEEP_LENGTH = 48
#: Segments up to this long share a matrix agenda.
SHORT = 48
#: Segments that one call of the library checks.
RUN = 64
#: Of each Arrow batch the text that is nearest to this many bytes is checked as a whole, too.
WHOLE = 4000


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field number and value of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            n = varint()
        yield tag >> 3, data[i : i + n]
        i += n


class Pieces:
    """A merge-type vocabulary."""

    def __init__(self, path: str):
        self.path = path
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append(d[1].decode())
                self.scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                self.types.append(d.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError(f"{path}: not a merge-type vocabulary")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or {USER, UNUSED} & set(self.types):
            raise ValueError(f"{path}: only identity normalisation without user-defined or unused pieces is built")
        self.prefix = bool(normalizer.get(3, 1))
        self.score = {p: (s, i) for i, (p, s, t) in enumerate(zip(self.pieces, self.scores, self.types)) if t == NORMAL}
        self.id = {p: i for p, (_, i) in self.score.items()}
        self._build_table()
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = [0] * 256
        for i, (p, t) in enumerate(zip(self.pieces, self.types)):
            if t == BYTE:
                self.bytes[int(p[3:-1], 16)] = i
        self.fallback = BYTE in self.types
        self.crossing = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.score)
        self.surface = [{NORMAL: p.replace(BLANK, " "), UNKNOWN: " ⁇ "}.get(t, "") for p, t in zip(self.pieces, self.types)]
        self.is_byte = np.array([t == BYTE for t in self.types])
        # the surfaces as one table of bytes, for decoding many texts at once
        shown = [bytes([self.bytes.index(i)]) if t == BYTE else x.encode() for i, (x, t) in enumerate(zip(self.surface, self.types))]
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_size = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_from = np.cumsum(self.shown_size) - self.shown_size
        self.byte_of = {i: b for b, i in enumerate(self.bytes)} if self.fallback else {}

    def _build_table(self) -> None:
        """The matrix agenda's symbols and pairs: a sign that is no piece has its code above the pieces."""
        n = len(self.pieces)
        self.symbol = np.arange(0x110000, dtype=np.int64) + n
        for p, i in self.id.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # pieces of equal score share a rank, so that the leftmost pair goes first
        ranks = {s: k for k, s in enumerate(sorted({s for s, _ in self.score.values()}, reverse=True))}
        part = lambda x: self.id.get(x, ord(x) + n if len(x) == 1 else None)
        pairs = {}
        for p, (s, i) in self.score.items():
            for k in range(1, len(p)):
                a, b = part(p[:k]), part(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = ranks[s], i
        self.table = MergeTable(pairs)

    def segments(self, text: str) -> list[str]:
        """The text with blanks as signs, cut where no merge can cross."""
        if not text:
            return []
        marked = (BLANK if self.prefix else "") + text.replace(" ", BLANK)
        if self.crossing:
            return [marked]
        if BLANK * 2 in marked or marked[0] != BLANK or marked[-1] == BLANK:
            return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", marked)
        return [BLANK + s for s in marked[1:].split(BLANK)]

    def merge(self, segment: str) -> list[int]:
        """Ids of one segment, by an agenda in a heap."""
        return self._ids(self._merged(segment))

    def merge_many(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments."""
        return [_listed(raw) for raw in self.merge_raw(segments)]

    def merge_raw(self, segments: list[str]) -> list[bytes]:
        """Ids (32 bits each) of many segments: the short ones go through the agenda together, as a matrix."""
        sizes = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        short = np.flatnonzero(sizes <= SHORT)
        out: list = [b""] * len(segments) if len(short) < len(segments) else []
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = np.array(self.merge(segments[i]), dtype="<i4").tobytes()
        if not len(short):
            return out
        own = [segments[i] for i in short.tolist()] if out else segments
        codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols, lengths = self.table.merge(self.symbol[codes], sizes[short])
        ends = np.cumsum(lengths)
        raw, stops = symbols.astype("<i4").tobytes(), (ends * 4).tolist()
        done = [raw[a:b] for a, b in zip([0, *stops], stops)]
        strange = np.flatnonzero(symbols >= len(self.pieces))
        for k in np.unique(np.searchsorted(ends, strange, side="right")).tolist():  # signs that are no piece
            held = symbols[ends[k] - lengths[k] : ends[k]].tolist()
            done[k] = np.array(self._ids([self.pieces[x] if x < len(self.pieces) else chr(x - len(self.pieces)) for x in held]), dtype="<i4").tobytes()
        if not out:
            return done
        for i, d in zip(short.tolist(), done):
            out[i] = d
        return out

    def _merged(self, segment: str) -> list[str]:
        symbols: list[str] = list(segment)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        score, agenda = self.score, []

        def consider(left: int, right: int) -> None:
            if left >= 0 and right < n:
                both = symbols[left] + symbols[right]
                if (known := score.get(both)) is not None:
                    heapq.heappush(agenda, (-known[0], left, right, len(both)))

        for i in range(n - 1):
            consider(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != size or after[left] != right:
                continue
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            consider(before[left], left)
            consider(left, after[left])
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            known = self.id.get(s)
            if known is not None:
                ids.append(known)
            elif self.fallback:
                ids.extend(self.bytes[b] for b in s.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for s in self.segments(text) for i in self.merge(s)]

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of the ids laid end to end (ends: 0 first), looked up in the table of surfaces.

        Texts whose byte pieces don't make up valid UTF-8 are read one by one, by decode().
        """
        sizes = self.shown_size[ids]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        data = self.shown[np.repeat(self.shown_from[ids] - stops[:-1], sizes) + np.arange(stops[-1])]
        texts = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            try:
                out = str(data[stops[a] : stops[b]], "utf-8")
            except UnicodeDecodeError:
                texts.append(self.decode(ids[a:b]))
                continue
            first = next((t for t in (self.types[i] for i in ids[a:b]) if t != CONTROL), None)
            texts.append(out[1:] if self.prefix and first == NORMAL and out[:1] == " " else out)
        return pa.array(texts, pa.string())

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; runs of byte pieces are read as UTF-8, what isn't valid as U+FFFD."""
        if not len(ids):
            return ""
        listed = ids.tolist()
        if not self.is_byte[ids].any():
            out = "".join(map(self.surface.__getitem__, listed))
        else:
            parts: list[str] = []
            run = bytearray()
            for i in listed:
                if i in self.byte_of:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    parts.append(_utf8(run))
                    run = bytearray()
                parts.append(self.surface[i])
            parts.append(_utf8(run))
            out = "".join(parts)
        first = next((i for i in listed if self.types[i] != CONTROL), None)
        return out[1:] if self.prefix and first is not None and self.types[first] == NORMAL and out[:1] == " " else out


def _utf8(run: bytearray) -> str:
    """The run as text; every byte that starts no valid sign becomes one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Segments:
    """Segments' ids as bytes, in two generations; `fresh` holds those that the library hasn't checked yet."""

    def __init__(self, vocabulary: Pieces, check: bool):
        self.vocabulary, self.check, self.fresh = vocabulary, check, {}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, end to end, and their ends (0 first). Each different segment of the batch is looked up once."""
        segments, of_text = _cut(texts, self.vocabulary)
        coded = segments.dictionary_encode()
        own = pc.replace_substring(coded.dictionary, " ", BLANK).to_numpy(zero_copy_only=False).tolist()
        raw = self._lookup(own)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        held = np.frombuffer(b"".join(raw), dtype="<i4")
        index = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[index]
        stops = np.concatenate([[0], np.cumsum(counts)])
        ids = held[np.repeat((np.cumsum(sizes) - sizes)[index] - stops[:-1], counts) + np.arange(stops[-1])]
        return ids, stops[np.searchsorted(of_text, np.arange(len(texts) + 1))]

    def _lookup(self, segments: list[str]) -> list[bytes]:
        if len(self.new) > KEEP_SEGMENTS:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        raw = list(map(new.get, segments))
        where = [k for k, r in enumerate(raw) if r is None]
        for k in where:
            raw[k] = old.get(segments[k])
        where = [k for k in where if raw[k] is None]
        unknown = [segments[k] for k in where]
        made = self.vocabulary.merge_raw(unknown)
        for k, ids in zip(where, made):
            raw[k] = ids
        if self.check:
            self.fresh.update(zip(unknown, made))
        new.update(zip(segments, raw))
        for s in unknown:
            if len(s) > KEEP_LENGTH:
                del new[s]
        return raw


def _cut(texts: pa.Array, vocabulary: Pieces) -> tuple[pa.Array, np.ndarray]:
    """The texts' segments (blank signs as blanks, prefix included), and the row of each; as Pieces.segments."""
    plain = pc.replace_substring(texts, BLANK, " ")
    if vocabulary.prefix:
        plain = pc.if_else(pc.equal(pc.binary_length(plain), 0), "", pc.binary_join_element_wise(pa.scalar(" "), plain, ""))
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer("".join(plain.to_pylist()).encode(), dtype=np.uint8)
    starts = ends[:-1][sizes > 0]
    if not vocabulary.crossing:
        blank = data == 32
        first = np.zeros(len(data), dtype=bool)
        first[1:] = blank[1:] & ~blank[:-1]
        first[starts] = True
        starts = np.flatnonzero(first)
    offsets = np.append(starts, len(data)).astype(np.int64)
    segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return segments, np.searchsorted(ends, starts, side="right") - 1


_loaded: dict[tuple[str, bool], tuple[Pieces, _Segments, object]] = {}


def _load(path: str, check: bool) -> tuple[Pieces, _Segments, object]:
    if (path, check) not in _loaded:
        library = None
        if check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = Pieces(path)
        _loaded[path, check] = vocabulary, _Segments(vocabulary, check), library
    return _loaded[path, check]


def _listed(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<i4").tolist()


def _verify(vocabulary: Pieces, segments: _Segments, library: object) -> None:
    """The library's ids of every new segment, and its text of them, must be ours.

    Segments that start with one blank sign are laid end to end, so that each call also shows that no merge crosses their
    borders; others are encoded by themselves.
    """
    fresh, segments.fresh = segments.fresh, {}
    joined = [s for s in fresh if len(s) > 1 and s[0] == BLANK and s[-1] != BLANK]
    runs = [joined[k : k + RUN] for k in range(0, len(joined), RUN)] if not vocabulary.crossing else [[s] for s in joined]
    runs += [[s] for s in fresh if not (len(s) > 1 and s[0] == BLANK and s[-1] != BLANK)]
    if vocabulary.prefix:
        runs = [r for r in runs if r[0][0] == BLANK]
    skip = int(vocabulary.prefix)
    theirs = library.encode(["".join(r)[skip:] for r in runs], num_threads=1) if runs else []
    ours = [_listed(b"".join(map(fresh.__getitem__, r))) for r in runs]
    for run, a, b in zip(runs, ours, theirs):
        if a != b and run != [BLANK]:  # one blank sign alone is an empty text's prefix, which the library leaves out
            raise ValueError(f"the library encodes {''.join(run)!r} as {b}, not {a}")
    for a, b in zip(ours, library.decode(ours, num_threads=1) if ours else []):
        if vocabulary.decode(np.array(a, dtype=np.int32)) != b:
            raise ValueError(f"the library decodes {a} to {b!r}")


def _verify_whole(text: str, ids: list[int], decoded: str, library: object) -> None:
    """The same of a whole text."""
    theirs = library.encode(text, num_threads=1)
    if theirs != ids or library.decode(theirs) != decoded:
        raise ValueError(f"the library encodes or decodes otherwise: {text[:200]!r}")


def encode_decode(df: DataFrame, *, text_col: str = "text", model: str | None = None, check: bool = True) -> DataFrame:
    """df with ids (array<int>) of each whole text, and decoded, the text of those ids."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    def work(texts: pa.Array) -> list[pa.Array]:
        vocabulary, segments, library = _load(path, check)
        ids, ends = segments.encode(texts)
        decoded = vocabulary.decode_many(ids, ends)
        if check:
            _verify(vocabulary, segments, library)
            k = int(np.abs(pc.binary_length(texts).to_numpy(zero_copy_only=False) - WHOLE).argmin())
            _verify_whole(texts[k].as_py(), ids[ends[k] : ends[k + 1]].tolist(), decoded[k].as_py(), library)
        return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), decoded]

    return with_arrow(df, text_col, [T.StructField("ids", T.ArrayType(T.IntegerType(), True)), T.StructField("decoded", T.StringType())], work)
