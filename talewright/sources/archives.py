"""Archives as sources: what they are, and their members within limits."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

MAX_ENTRIES, MAX_TOTAL, MAX_ENTRY, MAX_RATIO, RATIO_FROM, MAX_DEPTH, MAX_PATH = 1_000_000, 128 << 30, 8 << 30, 2000, 4 << 20, 4, 1024
_DEVICES = {"con", "prn", "aux", "nul", *(f"{n}{k}" for n in ("com", "lpt") for k in range(1, 10))}


class ArchiveError(ValueError):
    """A limit was passed: nothing more of that archive is read."""


@dataclass(frozen=True)
class Member:
    chain: tuple[str, ...]
    path: str
    data: bytes | None
    error: str | None = None


def classify(head: bytes, name: str = "") -> str | None:
    """zip, gzip, zstd or tar by the first bytes, else by the name."""
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    if head[257:262] == b"ustar":
        return "tar"
    low = name.lower()
    return next((k for e, k in ((".zip", "zip"), (".tar.gz", "gzip"), (".tgz", "gzip"), (".gz", "gzip"), (".tar", "tar"), (".zst", "zstd"), (".zstd", "zstd")) if low.endswith(e)), None)


def safe_path(name: str) -> str:
    """The member's path, or an error where it could leave a folder or name a device. Applying it again changes nothing."""
    path = name.replace("\\", "/")
    if not path or "\0" in path or len(path) > MAX_PATH or path.startswith("/") or re.match(r"^[A-Za-z]:", path):
        raise ArchiveError(f"unsafe path {name[:80]!r}")
    parts = [p for p in path.split("/") if p not in ("", ".")]
    for p in parts:
        if p == ".." or len(p.encode("utf-8", "surrogatepass")) > 255 or p.split(".")[0].strip().lower() in _DEVICES:
            raise ArchiveError(f"unsafe path {name[:80]!r}")
    if not parts:
        raise ArchiveError(f"unsafe path {name[:80]!r}")
    return "/".join(parts)


def _limited(stream: io.BufferedIOBase, stored: int, spent: list[int]) -> bytes:
    out = bytearray()
    while piece := stream.read(1 << 20):
        out += piece
        spent[0] += len(piece)
        if len(out) > MAX_ENTRY or spent[0] > MAX_TOTAL:
            raise ArchiveError("a member or the archive is too large")
        if len(out) > RATIO_FROM and stored and len(out) > stored * MAX_RATIO:
            raise ArchiveError("a member expands too far")
    return bytes(out)


def members(name: str, data: bytes, chain: tuple[str, ...] = (), spent: list[int] | None = None) -> Iterator[Member]:
    """All regular members, archives inside archives included; a member that can't be read is an error of its own."""
    spent = [0, 0] if spent is None else spent
    kind = classify(data[:512], name)
    own = (*chain, name)
    if len(own) > MAX_DEPTH:
        yield Member(chain, name, None, "archives are nested too deep")
        return

    def inner(path: str, raw: bytes) -> Iterator[Member]:
        spent[1] += 1
        if spent[1] > MAX_ENTRIES:
            raise ArchiveError("too many members")
        if classify(raw[:512]) is not None:
            yield from members(path, raw, own, spent)
        else:
            yield Member(own, path, raw)

    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in sorted(z.infolist(), key=lambda i: i.filename):
                if info.is_dir() or (info.external_attr >> 16) & 0o170000 not in (0, 0o100000):
                    continue
                try:
                    path = safe_path(info.filename)
                    with z.open(info) as f:
                        raw = _limited(f, info.compress_size, spent)
                except ArchiveError as e:
                    if "unsafe" not in str(e):
                        raise
                    yield Member(own, info.filename, None, str(e))
                    continue
                except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as e:
                    yield Member(own, info.filename, None, str(e))
                    continue
                yield from inner(path, raw)
    elif kind == "tar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            infos = []
            try:
                infos += (i for i in t if i.isreg())
            except (tarfile.TarError, EOFError) as e:  # what came before it is read
                yield Member(own, name, None, f"the archive breaks off: {e}")
            for info in sorted(infos, key=lambda i: i.name):
                try:
                    path = safe_path(info.name)
                    raw = _limited(t.extractfile(info), 0, spent)
                    if len(raw) < info.size:
                        raise EOFError("the member breaks off")
                except ArchiveError as e:
                    if "unsafe" not in str(e):
                        raise
                    yield Member(own, info.name, None, str(e))
                    continue
                except (tarfile.TarError, EOFError, OSError) as e:
                    yield Member(own, info.name, None, str(e))
                    continue
                yield from inner(path, raw)
    elif kind in ("gzip", "zstd"):
        if kind == "gzip":
            raw = _limited(gzip.GzipFile(fileobj=io.BytesIO(data)), len(data), spent)
        else:
            import zstandard

            raw = _limited(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)), len(data), spent)
        base = re.sub(r"\.(gz|zst|zstd)$", "", re.sub(r"\.tgz$", ".tar", name.rsplit("/", 1)[-1]), flags=re.I)
        yield from inner(base, raw)
    else:
        yield Member(chain, name, data)
