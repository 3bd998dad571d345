"""Bounded readers of records: numbered lines, elements of a JSON array, complete objects of a probe."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

MAX_RECORD = 64 << 20
PROBE = 16 << 10


def lines(data: bytes, most: int = MAX_RECORD) -> Iterator[tuple[int, bytes | None, int]]:
    """(number from 1, line or nothing where it is over `most` bytes, its size); blank lines are numbered but not given."""
    for number, line in enumerate(data.split(b"\n"), 1):
        if number == 1:
            line = line.removeprefix(b"\xef\xbb\xbf")
        line = line.rstrip(b"\r\n \t")
        if line.strip():
            yield number, (line if len(line) <= most else None), len(line)


def objects(data: bytes, most: int = MAX_RECORD) -> Iterator[tuple[int, dict | None, str | None]]:
    """(line number, JSON object or nothing, what is wrong with it) of each line."""
    for number, line, size in lines(data, most):
        if line is None:
            yield number, None, f"record of {size} bytes is over the limit"
            continue
        try:
            value = json.loads(line)
        except (ValueError, RecursionError) as e:
            yield number, None, f"invalid JSON: {e}"
            continue
        yield (number, value, None) if isinstance(value, dict) else (number, None, "not an object")


def elements(data: bytes) -> Iterator[tuple[int, Any, str | None]]:
    """Elements of a top-level array as they are read: those before a syntax error are given, then the error."""
    text = data.decode("utf-8-sig", "replace")
    decoder = json.JSONDecoder()
    at = len(text) - len(text.lstrip())
    if text[at : at + 1] != "[":
        yield 0, None, "not an array"
        return
    at += 1
    index = 0
    while True:
        while text[at : at + 1] in (" ", "\n", "\r", "\t", ","):
            at += 1
        if text[at : at + 1] == "]":
            return
        try:
            value, at = decoder.raw_decode(text, at)
        except (ValueError, RecursionError) as e:
            yield index, None, f"invalid JSON: {e}"
            return
        yield index, value, None
        index += 1


def probe(head: bytes) -> list[dict]:
    """Complete objects among the lines of a file's head; a last line that is cut is left out."""
    return [v for _, v, error in objects(head) if error is None]
