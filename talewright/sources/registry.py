"""Which parser reads a file: every parser scores the path and the first 16 KiB, the best wins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from . import exports, sessions, stores
from .lines import PROBE, probe

NONE, WEAK, STRONG, CERTAIN = range(4)
SQLITE = b"SQLite format 3\0"


@dataclass(frozen=True)
class Parser:
    id: str
    provider: str
    application: str
    detect: Callable[[str, bytes], int]
    parse: Callable[[str, bytes], Iterator[dict]]
    version: str = "1"


def _keys(head: bytes) -> list[set]:
    return [set(v) for v in probe(head)[:20]]


def _name(path: str) -> str:
    return path.replace("\\", "/").rsplit("/", 1)[-1].lower()


def _claude(path: str, head: bytes) -> int:
    hit = any({"sessionId", "type"} <= k and k & {"uuid", "parentUuid", "message", "isSidechain", "leafUuid"} for k in _keys(head))
    return NONE if not hit else CERTAIN if ".claude/projects" in path.replace("\\", "/") else STRONG


def _codex(path: str, head: bytes) -> int:
    found = probe(head)[:20]
    hit = any(v.get("type") in ("session_meta", "turn_context", "response_item") and isinstance(v.get("payload"), dict) for v in found) or bool(found and {"id", "timestamp", "instructions"} <= set(found[0]))
    return NONE if not hit else CERTAIN if ".codex/" in path.replace("\\", "/") or _name(path).startswith("rollout-") else STRONG


def _pi(fork: bool) -> Callable[[str, bytes], int]:
    def detect(path: str, head: bytes) -> int:
        found = probe(head)[:5]
        if not any(v.get("type") == "session" and "version" in v and "id" in v for v in found):
            return NONE
        own = found[0].get("type") == "title" or ".omp/" in path.replace("\\", "/")
        return CERTAIN if own == fork else NONE

    return detect


def _has(*needles: bytes, ends: tuple[str, ...] = (".json",), score: int = STRONG) -> Callable[[str, bytes], int]:
    return lambda path, head: score if _name(path).endswith(ends) and all(x in head for x in needles) else NONE


def _takeout(path: str, head: bytes) -> int:
    if b'"conversation_turns"' in head:
        return STRONG
    if _name(path).endswith((".html", ".htm")) and b"outer-cell" in head and re.search(rb"gemini|bard", head, re.I):
        return STRONG
    return WEAK if b'"safeHtmlItem"' in head and re.search(rb"gemini|bard", head, re.I) else NONE


def _opencode(path: str, head: bytes) -> int:
    if head.startswith(SQLITE):
        return STRONG if "opencode" in path.lower() or b"message_id" in head and b"CREATE TABLE" in head and b"session_id" in head and b"part" in head else NONE
    return STRONG if b'"messages"' in head and b'"info"' in head and re.search(rb'"(ses|msg|prt)_', head) else NONE


def _hermes(path: str, head: bytes) -> int:
    if head.startswith(SQLITE):
        return STRONG if b"system_prompt" in head and b"sessions" in head and b"finish_reason" in head else NONE
    if b'"session_meta"' in head and any(v.get("role") == "session_meta" for v in probe(head)[:1]):
        return STRONG
    return STRONG if b'"session_start"' in head and b'"session_id"' in head else NONE


def _gemini_cli(path: str, head: bytes) -> int:
    if b'"sessionId"' not in head or b'"projectHash"' not in head and b'"startTime"' not in head:
        return NONE
    return CERTAIN if ".gemini/" in path.replace("\\", "/") else STRONG


def _lines_with(*keys: str, name: str = "", score: int = STRONG) -> Callable[[str, bytes], int]:
    return lambda path, head: score if re.search(name, path.replace("\\", "/")) and any(set(keys) <= k for k in _keys(head)) else NONE


def _generic(ends: tuple[str, ...]) -> Callable[[str, bytes], int]:
    return lambda path, head: WEAK if _name(path).endswith(ends) and re.search(rb'"role"\s*:\s*"', head) and re.search(rb'"(content|text)"\s*:\s*"', head) else NONE


#: In order of registration, which decides between equal scores.
PARSERS: tuple[Parser, ...] = (
    Parser("claude_code", "anthropic", "claude-code", _claude, sessions.claude_code),
    Parser("codex", "openai", "codex", _codex, sessions.codex),
    Parser("chatgpt_export", "openai", "chatgpt", _has(b'"mapping"'), exports.chatgpt),
    Parser("claude_web_export", "anthropic", "claude", _has(b'"chat_messages"'), exports.claude_web),
    Parser("claude_design_export", "anthropic", "claude-design", lambda p, h: STRONG if "design_chats/" in p.replace("\\", "/") and b'"messages"' in h and b'"uuid"' in h else NONE, exports.claude_design),
    Parser("gemini_takeout", "google", "gemini", _takeout, exports.gemini_takeout),
    Parser("perplexity_export", "perplexity", "perplexity", _has(b'"conversations"', b'"context_uuid"', b'"entries"'), exports.perplexity),
    Parser("opencode", "opencode", "opencode", _opencode, stores.opencode),
    Parser("pi", "pi", "pi", _pi(False), sessions.pi),
    Parser("oh_my_pi", "pi", "oh-my-pi", _pi(True), sessions.pi),
    Parser("hermes", "nousresearch", "hermes-agent", _hermes, stores.hermes),
    Parser("gemini_cli", "google", "gemini-cli", _gemini_cli, sessions.gemini_cli),
    Parser("antigravity", "google", "antigravity-cli", _lines_with("type", "step_index"), sessions.antigravity),
    Parser("minimax", "minimax", "minimax", _lines_with("message", name=r"(messages\.jsonl|snapshots/g\d+--ctx_[^/]*\.jsonl)$"), sessions.minimax),
    Parser("deepseek", "deepseek", "deepseek", _lines_with("type", name=r"session\.v4\.jsonl"), sessions.deepseek),
    Parser("generic_jsonl", "unknown", "generic-jsonl", _generic((".jsonl", ".ndjson")), sessions.generic_jsonl),
    Parser("generic_json", "unknown", "generic-json", _generic((".json",)), sessions.generic_json),
)
BY_ID = {p.id: p for p in PARSERS}

#: Files that are listed but not imported: (pattern of the path, signs in the head or none, format, why). The first that fits counts.
UNSUPPORTED: tuple[tuple[str, bytes | None, str, str], ...] = (
    (r"\.(db|sqlite3?|vscdb)-(wal|shm|journal)$", None, "sqlite_companion", "read together with its database"),
    (r"(^|/)CURRENT$|(^|/)MANIFEST-\d+$|\.(ldb|sst)$", None, "leveldb", "listed as unresolved"),
    (r"(^|/)\.claude/(todos|statsig|shell-snapshots|plugins|ide|file-history|debug|session-env)/", None, "claude_code_state", "no messages"),
    (r"(^|/)\.claude/projects/.*/(tool-results|memory)/", None, "claude_code_side_file", "kept beside a session, which has the reference"),
    (r"(^|/)\.claude/projects/.*\.meta\.json$", None, "claude_code_meta", "a side agent's description"),
    (r"(^|/)sessions-index\.json$", None, "claude_code_index", "an index of sessions"),
    (r"(^|/)\.claude/(settings|\.?credentials|stats-cache)[^/]*\.json$", None, "claude_code_settings", "settings or credentials"),
    (r"(^|/)\.codex/(auth|config|version|models_cache|internal_storage)\.(json|toml)$", None, "codex_state", "no messages"),
    (r"(^|/)session_index\.jsonl$", None, "codex_index", "an index of sessions"),
    (r"(^|/)history\.jsonl$", None, "prompt_history", "prompts without conversations"),
    (r"\.pb$", None, "protobuf_store", "the format isn't published"),
    (r"(^|/)\.gemini/antigravity[^/]*/.*/(implementation_plan|task|walkthrough)[^/]*\.md(\.|$)", None, "antigravity_document", "a document that the agent wrote"),
    (r"(^|/)\.gemini/antigravity[^/]*/.*\.(png|webp|jpe?g|webm)$", None, "antigravity_media", "a picture or recording"),
    (r"(^|/)\.gemini/antigravity[^/]*/.*transcript\.jsonl$", None, "antigravity_short_transcript", "the full transcript beside it is imported"),
    (r"(^|/)\.gemini/antigravity[^/]*/(knowledge|annotations|code_tracker|implicit|context_state|browser_recordings)/", None, "antigravity_state", "no messages"),
    (r"(^|/)\.gemini/.*(logs|checkpoint[^/]*)\.json$", None, "gemini_cli_log", "prompts or checkpoints without a conversation"),
    (r"(^|/)\.project_root$", None, "gemini_cli_marker", "the path of a project"),
    (r"(^|/)\.minimax/.*/(manifest|meta|index|state)\.json$", None, "minimax_state", "a session's description"),
    (r"(^|/)\.minimax/.*\.(log|tmp|lock)$", None, "minimax_log", "a log or lock"),
    (r"(^|/)\.minimax/.*/(skills|agents|mcp|cache|attachments)/", None, "minimax_assets", "assets, no messages"),
    (r"(^|/)\.dsh/.*/(state|meta|config|index)\.json$", None, "deepseek_state", "a session's description"),
    (r"(^|/)\.dsh/.*\.(log|lock|tmp)$", None, "deepseek_log", "a log or lock"),
    (r"(^|/)\.hermes/(config\.ya?ml|\.env|auth\.json)$", None, "hermes_settings", "settings or credentials"),
    (r"(^|/)\.hermes/(skills|memories|cron|logs|cache)/", None, "hermes_state", "no messages"),
    (r"(^|/)opencode/(auth|mcp-auth)\.json$", None, "opencode_settings", "credentials"),
    (r"(^|/)opencode/(log|snapshot|bin|tool-output)/", None, "opencode_state", "no messages"),
    (r"(^|/)opencode/storage/(session_diff|todo|project|migration)", None, "opencode_side_file", "no messages"),
    (r"(^|/)AnthropicClaude/(app-[^/]*|packages)(/|$)", None, "desktop_installation", "files of an installation"),
    (r"\.(xlsx|pptx|docx)(!?/)", None, "office_part", "a part of an office document"),
    (r"(^|/)NotebookLM/", None, "takeout_notebook", "a notebook's sources"),
    (r"(^|/)gemini_[^/]*\.html$", None, "takeout_side_file", "a listing of gems or scheduled actions"),
    (r"(^|/)conversation_[^/]*_turn_[^/]*_images_[^/]*$", None, "takeout_image", "a conversation keeps the reference"),
    (r"gemini apps/(?!.*myactivity\.(html|json)$)", None, "takeout_attachment", "cards refer to it"),
    (r"(^|/)perplexity[^/]*/.*(collections|spaces|profile|settings)\.json$", None, "perplexity_side_file", "no conversations"),
    (r"(^|/)conversations(-\d+)?\.json$", None, "unknown_web_export", "conversations of an unknown form"),
    (r"(^|/)manifest-[^/]*\.json$", b'"data_files"', "claude_export_manifest", "a list of the export's parts"),
    (r"(^|/)memories/", b'"memory_files"', "claude_export_memories", "memories, no messages"),
    (r"(^|/)projects/", b'"prompt_template"', "claude_export_projects", "definitions of projects"),
    (r"(^|/)reflections/", b'"reflections"', "claude_export_feedback", "feedback"),
    (r"(^|/)artifacts/(.*/)?(artifact\.json|[^/]*\.html)$", None, "claude_export_frames", "versions of a document"),
    (r"(^|/)login_history\.json$", b'"login_events"', "claude_export_account", "account data"),
    (r"(^|/)export_manifest\.json$", b'"export_files"', "chatgpt_export_manifest", "a list of the export's files"),
    (r"(^|/)export_manifest\.json$", b'"logical_files"', "chatgpt_export_manifest", "a list of the export's files"),
    (r"(^|/)sites/(.*/)?export_manifest\.json$", None, "chatgpt_export_manifest", "a list of sites"),
    (r"(^|/)ads\.json$", b'"ads_profile"', "chatgpt_export_account", "account data"),
    (r"(^|/)(user_settings|user)\.json$", None, "chatgpt_export_account", "account data"),
    (r"(^|/)library_files\.json$", b'"file_id"', "chatgpt_export_library", "conversations keep the references"),
    (r"(^|/)(conversation_asset_file_names|sectioned_conversations)\.json$", None, "chatgpt_export_index", "an index"),
    (r"(^|/)chat\.html$", None, "chatgpt_html", "the JSON beside it is imported"),
    (r"(^|/)(message_feedback|shared_conversations|model_comparisons)\.json$", None, "chatgpt_export_side_file", "feedback or sharing"),
    (r"(^|/)(projects|users|memories)\.json$", None, "export_side_file", "no messages"),
    (r"(^|/)file[-_][^/]*\.(png|jpe?g|webp|gif|pdf|txt|wav|mp3|dat)$", None, "chatgpt_export_attachment", "conversations keep the reference"),
    (r"(^|/)Cursor/User/.*state\.vscdb$", None, "cursor_store", "the format isn't published"),
    (r"(^|/)(Cache|Code Cache|GPUCache|Service Worker|IndexedDB)/", None, "browser_store", "a browser's store"),
)


def detect(path: str, head: bytes, only: str | None = None) -> list[tuple[Parser, int]]:
    """All parsers with a score, the best first; equal scores keep the order of registration."""
    own = [p for p in PARSERS if only in (None, p.id)]
    return sorted(((p, s) for p in own if (s := p.detect(path, head[:PROBE])) > NONE), key=lambda x: -x[1])


def unsupported(path: str, head: bytes = b"") -> tuple[str, str] | None:
    """(format, why) of a known file that isn't imported."""
    plain = path.replace("\\", "/")
    return next(((kind, why) for pattern, signs, kind, why in UNSUPPORTED if re.search(pattern, plain, re.I) and (signs is None or signs in head[:PROBE])), None)
