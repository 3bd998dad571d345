"""Normal forms of paths and git remotes, and what they say about machine and project."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """One form for a path however a tool wrote it: forward slashes, drives as c:/, no trailing slash; only Windows paths lose their case."""
    s = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    s = F.regexp_replace(s, r"^//\?/UNC/", "//")
    s = F.regexp_replace(s, r"^//\?/", "")
    s = F.regexp_replace(s, r"^/mnt/([A-Za-z])(?=/|$)", "$1:")
    windows = s.rlike(r"^[A-Za-z]:(/|$)") | s.startswith("//")
    s = F.when(windows, F.lower(s)).otherwise(s)
    s = F.regexp_replace(s, r"(?<=.)/+$", "")
    return F.when(s.rlike(r"^[a-z]:$"), F.concat(s, F.lit("/"))).otherwise(s)


def path_within(path: Column, prefix: Column) -> Column:
    """Whether path is prefix or lies below it, by whole components."""
    bare = F.regexp_replace(prefix, "/+$", "")
    return (path == prefix) | (path == bare) | path.startswith(F.concat(bare, F.lit("/")))


def normalize_remote(url: Column) -> Column:
    """host/owner/name of a git remote in any of its spellings."""
    s = F.trim(url)
    s = F.regexp_replace(s, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    s = F.regexp_replace(s, r"^[^@/]+@", "")
    s = F.regexp_replace(s, r"^([^/:]+):(?:\d+/)?", "$1/")
    s = F.regexp_replace(F.regexp_replace(s, "/+$", ""), r"\.git$", "")
    return F.lower(F.regexp_replace(s, "/{2,}", "/"))


def platform_hint(path: Column) -> Column:
    s = F.replace(path, F.lit("\\"), F.lit("/"))
    return (
        F.when(s.rlike(r"^[A-Za-z]:(/|$)") | s.startswith("//"), "windows")
        .when(s.startswith("/mnt/") | s.startswith("/home/") | s.startswith("/root"), "linux")
        .when(s.startswith("/Users/") | s.startswith("/private/"), "macos")
        .otherwise("unknown")
    )


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)


def norm_role(role: Column) -> Column:
    """One of user, assistant, system, tool, developer and other."""
    r = F.lower(F.trim(role))
    return (
        F.when(r.isin("user", "human"), "user")
        .when(r.isin("assistant", "ai", "model", "bot"), "assistant")
        .when(r.isin("tool", "tool_result", "function"), "tool")
        .when(r.isin("system", "developer"), r)
        .otherwise("other")
    )


def mapped_path(path: Column, staged: str, original: str) -> Column:
    """The path that a file copied from elsewhere had there; paths outside of the staging folder stay."""
    root = staged.rstrip("/")
    inside = path.startswith(root + "/")
    return F.when(inside, F.concat(F.lit(original.rstrip("/")), F.substring(path, len(root) + 1, 100_000))).otherwise(path)
