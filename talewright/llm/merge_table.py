"""Merging of many short words at once: the agenda of adjacent pairs as a matrix."""

from __future__ import annotations

import numpy as np

_NONE = np.iinfo(np.int32).max
#: Low bits of an agenda's entry: the place of its pair in the word.
_PLACE_BITS = 6
#: A symbol that merges with none, and the mark of a symbol that was merged into the one before.
_EDGE, _GONE = (1 << 21) - 1, -1
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Which pairs of symbols (below 2**21 - 1) merge, in which order (rank, lower first), into what: an open hash table."""

    #: Longest word that merge() takes.
    LONGEST = (1 << _PLACE_BITS) - 2

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        codes = np.array([a << 21 | b for a, b in pairs], dtype=np.int64)
        values = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)
        bits = max(4, int(4 * len(codes)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), 1 << bits
        self.codes = np.full(self.last, -1, dtype=np.int64)
        self.ranks = np.full(self.last + 1, _NONE, dtype=np.int32)
        self.merged = np.zeros(self.last + 1, dtype=np.int64)
        rest, self.steps = np.arange(len(codes)), 0
        while len(rest):
            slot = (self._slot(codes[rest]) + self.steps) % self.last
            free = self.codes[slot] == -1
            _, winner = np.unique(slot[free], return_index=True)
            winner = np.flatnonzero(free)[winner]
            self.codes[slot[winner]] = codes[rest[winner]]
            self.ranks[slot[winner]] = values[rest[winner], 0] << _PLACE_BITS
            self.merged[slot[winner]] = values[rest[winner], 1]
            rest = np.delete(rest, winner)
            self.steps += 1

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code.astype(np.uint64) * _FACTOR >> self.shift).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of the pairs in the table; the last one where a pair never merges."""
        code = (a << 21) | b
        slot = self._slot(code)
        held = self.codes[slot]
        out = np.where(held == code, slot, self.last)
        rest = np.flatnonzero((held != code) & (held != -1))
        for step in range(1, self.steps):
            if not len(rest):
                break
            at = (slot[rest] + step) % self.last
            held = self.codes[at]
            hit = held == code[rest]
            out[rest[hit]] = at[hit]
            rest = rest[~hit & (held != -1)]
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray, words: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """Words laid end to end with their lengths, merged until no pair is left.

        In each round every word merges its pair of least rank, the leftmost of several, as an agenda would; words of about
        one length are worked on together.
        """
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(lengths, kind="stable")
        order = order[np.searchsorted(lengths[order], 2) :]  # a single symbol is done
        out = symbols.astype(np.int64)
        for k in range(0, len(order), words):
            own = order[k : k + words]
            self._rounds(out, starts[own], lengths[own])
        gone = out == _GONE
        left = lengths - np.diff(np.concatenate([[0], np.cumsum(gone)])[np.append(starts, len(out))])
        return out[~gone], left

    def _rounds(self, out: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """A column for each word, with an edge before and after it; merged-away symbols become _GONE in `out`."""
        n, width = len(starts), int(lengths.max())
        row = np.arange(width)[:, None]
        inside = row < lengths
        word = np.full((width + 2, n), _EDGE, dtype=np.int64)
        word[1:-1][inside] = out[(starts + row)[inside]]
        pair = np.full((width + 2, n), self.last, dtype=np.int64)
        pair[1:-1] = self.find(word[1:-1].ravel(), word[2:].ravel()).reshape(width, n)
        place = np.arange(width + 2, dtype=np.int32)[:, None]
        agenda = self.ranks[pair]
        agenda = np.where(agenda == _NONE, _NONE, agenda | place)
        after = np.repeat(place + 1, n, axis=1).ravel()
        before = np.repeat(place - 1, n, axis=1).ravel()
        flat, pairs, keys = word.ravel(), pair.ravel(), agenda.ravel()
        while True:
            best = agenda.min(axis=0)
            live = np.flatnonzero(best != _NONE)
            if not len(live):
                break
            p = (best[live] & ((1 << _PLACE_BITS) - 1)).astype(np.int64)
            at = p * n + live
            q = after[at]
            gone = q * n + live
            flat[at] = self.merged[pairs[at]]
            flat[gone] = _GONE
            keys[gone] = _NONE
            right = after[gone]
            after[at] = right
            right = right * n + live
            before[right] = p
            left = before[at] * n + live
            for first, second in ((at, right), (left, at)):
                found = self.find(flat[first], flat[second])
                pairs[first] = found
                rank = self.ranks[found]
                keys[first] = np.where(rank == _NONE, _NONE, rank | (first // n).astype(np.int32))
        out[(starts + row)[inside]] = word[1:-1][inside]
