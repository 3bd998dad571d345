"""Where known tools keep their sessions, which files of a store are wanted, and an inventory of LevelDB stores."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

from .ingest import walk


@dataclass(frozen=True)
class Store:
    app: str
    base: str  # home, config, data or state
    path: str
    systems: tuple[str, ...] = ("posix", "windows")
    wanted: tuple[str, ...] | None = None  # nothing: inventory only


_LINES = ("**/*.jsonl",)
_OPENCODE = tuple("storage/**/*.json *.db".split())
STORES: tuple[Store, ...] = (
    Store("claude-code", "home", ".claude/projects", wanted=_LINES),
    Store("claude-code", "config", "claude/projects", ("posix",), _LINES),
    Store("codex", "home", ".codex/sessions", wanted=_LINES),
    Store("codex", "home", ".codex/archived_sessions", wanted=_LINES),
    Store("opencode", "data", "opencode", ("posix",), _OPENCODE),
    Store("opencode", "home", ".local/share/opencode", ("windows",), _OPENCODE),
    Store("pi", "home", ".pi/agent/sessions", wanted=_LINES),
    Store("omp", "home", ".omp/agent/sessions", wanted=_LINES),
    Store("hermes", "home", ".hermes", wanted=tuple(p + s for s in "sessions/*.jsonl state.db sessions/session_*.json".split() for p in ("profiles/*/", ""))),
    Store("antigravity", "home", ".gemini/antigravity", wanted=()),
    Store("antigravity", "home", ".gemini/antigravity-cli", wanted=("brain/*/.system_generated/logs/transcript_full.jsonl",)),
    Store("gemini", "home", ".gemini/tmp", wanted=("*/.project_root", *(f"*/chats/session-*.{e}" for e in ("json", "jsonl")))),
    Store("minimax", "home", ".minimax", wanted=tuple(f"v2/sessions/**/{n}.jsonl" for n in ("g*--ctx_*", "messages"))),
    Store("deepseek", "home", ".dsh", wanted=tuple("sessions/*/*/session.v4.jsonl" + e for e in ("", ".zstd"))),
    Store("claude-desktop", "config", "Claude"),
    Store("chatgpt-desktop", "config", "ChatGPT"),
    Store("cursor", "config", "Cursor/User/workspaceStorage"),
    Store("claude-desktop", "data", "Claude"),
    Store("claude-desktop", "data", "AnthropicClaude", ("windows",)),
    Store("claude-desktop", "state", "Claude", ("posix",)),
)
ORIGINS = ("https://chatgpt.com", "https://chat.openai.com", "https://claude.ai", "https://gemini.google.com", "https://www.perplexity.ai", "https://chat.deepseek.com")
MAX_LEVELDB_FILE, MAX_LEVELDB, MAX_LEVELDB_FILES = 64 << 20, 256 << 20, 4096


def bases(env: Mapping[str, str], windows: bool = os.name == "nt") -> dict[str, str]:
    """The folders that stores' paths start from."""
    home = env.get("USERPROFILE" if windows else "HOME", "")
    if windows:
        return {"home": home, "config": env.get("APPDATA", f"{home}/AppData/Roaming"), "data": env.get("LOCALAPPDATA", f"{home}/AppData/Local"), "state": env.get("LOCALAPPDATA", f"{home}/AppData/Local")}
    return {"home": home, "config": env.get("XDG_CONFIG_HOME") or f"{home}/.config", "data": env.get("XDG_DATA_HOME") or f"{home}/.local/share", "state": env.get("XDG_STATE_HOME") or f"{home}/.local/state"}


def roots(env: Mapping[str, str], windows: bool = os.name == "nt") -> list[tuple[Store, str]]:
    """Stores that are there, once for each folder; CLAUDE_CONFIG_DIR and CODEX_HOME move theirs."""
    where = bases(env, windows)
    out: dict[str, Store] = {}
    for s in STORES:
        if ("windows" if windows else "posix") not in s.systems:
            continue
        path = f"{where[s.base]}/{s.path}"
        if s.path.startswith(".claude/") and env.get("CLAUDE_CONFIG_DIR"):
            path = f"{env['CLAUDE_CONFIG_DIR']}/{s.path.removeprefix('.claude/')}"
        if s.path.startswith(".codex/") and env.get("CODEX_HOME"):
            path = f"{env['CODEX_HOME']}/{s.path.removeprefix('.codex/')}"
        if os.path.isdir(path):
            out.setdefault(os.path.abspath(path), s)
    return [(s, p) for p, s in out.items()]


def glob_matches(pattern: str, path: str) -> bool:
    """`*` stays within a folder, `**` spans any number of them."""
    made = re.escape(pattern).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*")
    return re.fullmatch(made, path, re.S) is not None


def wanted(store: Store, rel: str) -> bool:
    """Whether a file of the store is read; companions of a database (-wal, -shm, -journal) follow it."""
    rel = rel.replace("\\", "/")
    base = re.sub(r"-(wal|shm|journal)$", "", rel)
    return any(glob_matches(p, rel) or base != rel and p.endswith(".db") and glob_matches(p, base) for p in store.wanted or ())


def candidates(env: Mapping[str, str], windows: bool = os.name == "nt") -> Iterator[tuple[str, str]]:
    """(app, file) of all wanted files."""
    for s, root in roots(env, windows):
        for path, _, _ in walk(root):
            if wanted(s, os.path.relpath(path, root)):
                yield s.app, path


def is_leveldb(folder: str) -> bool:
    names = os.listdir(folder)
    return "CURRENT" in names and any(n.startswith("MANIFEST-") for n in names)


def leveldb_inventory(folder: str) -> dict:
    """A store as one unresolved source: its size, and which web origins its files mention."""
    files = sorted(p for p in Path(folder).iterdir() if p.is_file())[:MAX_LEVELDB_FILES]
    found: set[str] = set()
    read = 0
    for p in files:
        size = p.stat().st_size
        if p.suffix in (".ldb", ".log", ".sst") and size <= MAX_LEVELDB_FILE and read + size <= MAX_LEVELDB:
            data = p.read_bytes()
            read += size
            found |= {o for o in ORIGINS if o.encode() in data or o.encode("utf-16-le") in data}
    return {"path": folder, "format": "leveldb", "status": "unresolved", "files": len(files), "bytes": sum(p.stat().st_size for p in files), "origins": sorted(found)}
