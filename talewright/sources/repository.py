"""The git remote of a working directory, read from its repository's configuration."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folders that are looked at on the way up, and bytes that are read of a configuration.
MAX_UP, MAX_CONFIG = 8, 1 << 20


def first_remote(text: str) -> str | None:
    """The first url of a remote section of a git configuration."""
    inside = False
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("["):
            inside = re.match(r'\[remote\s+"', line) is not None
        elif inside and (m := re.match(r"url\s*=\s*(.+)$", line)):
            return m[1].strip().strip('"')
    return None


def find_repo(folder: str) -> Path | None:
    """The git folder of the repository that holds a directory: at most MAX_UP steps up; a worktree's leads to its main one."""
    here = Path(folder)
    for at in [here, *here.parents][: MAX_UP + 1]:
        git = at / ".git"
        if git.is_dir():
            return git
        if git.is_file():
            m = re.match(r"gitdir:\s*(.+)", git.read_text(errors="replace").strip())
            if not m:
                return None
            target = (at / m[1].strip()).resolve()
            common = target / "commondir"
            return (target / common.read_text().strip()).resolve() if common.is_file() else target
    return None


def git_remote(folder: str) -> str | None:
    try:
        git = find_repo(folder)
        return first_remote((git / "config").read_text(errors="replace")[:MAX_CONFIG]) if git else None
    except OSError:
        return None


def remotes(df: DataFrame, *, path_col: str) -> DataFrame:
    """(path, remote) of the distinct directories that lie in a repository, looked up where the task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([git_remote(p) for p in paths], pa.string())], names=[path_col, "remote"])

    return df.select(path_col).where(F.col(path_col).startswith("/")).distinct().mapInArrow(run, f"{path_col} string, remote string").where("remote is not null")
