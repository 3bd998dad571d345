"""Configuration in TOML: machines, aliases, secrets and limits. Unknown keys are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Machine:
    id: str
    paths: list[str] = field(default_factory=list)
    platform: str | None = None
    aliases: list[str] = field(default_factory=list)


@dataclass
class ProjectAlias:
    project: str
    paths: list[str] = field(default_factory=list)
    repository: str | None = None


@dataclass
class RepositoryAlias:
    repository: str
    remotes: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)


@dataclass
class Secrets:
    policy: str = "redact"


@dataclass
class Limits:
    max_file_bytes: int = 2 << 30
    max_record_bytes: int = 64 << 20
    max_artifact_bytes: int = 512 << 20
    max_stage_bytes: int = 64 << 30
    max_files: int = 2_000_000
    max_depth: int = 48
    max_inline_text_bytes: int = 32 << 10
    skip_extensions: list[str] = field(default_factory=lambda: ["exe", "dll", "so", "png", "jpg", "mp4", "mp3", "iso", "bin", "o", "class"])


@dataclass
class Config:
    machine: list[Machine] = field(default_factory=list)
    project_alias: list[ProjectAlias] = field(default_factory=list)
    repository_alias: list[RepositoryAlias] = field(default_factory=list)
    secrets: Secrets = field(default_factory=Secrets)
    limits: Limits = field(default_factory=Limits)

    def machine_rules(self, spark: SparkSession) -> DataFrame:
        """(ord, prefix, machine) in the order of the file."""
        return spark.createDataFrame([(k, p, m.id) for k, (m, p) in enumerate((m, p) for m in self.machine for p in m.paths)], "ord int, prefix string, machine string")

    def project_rules(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, p, a.project) for k, (a, p) in enumerate((a, p) for a in self.project_alias for p in a.paths)], "ord int, prefix string, project string")


def _make(kind: type, values: dict, where: str) -> object:
    known = {f.name for f in fields(kind)}
    if unknown := set(values) - known:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    return kind(**values)


def load(text: str) -> Config:
    raw = tomllib.loads(text)
    lists = {"machine": Machine, "project_alias": ProjectAlias, "repository_alias": RepositoryAlias}
    if unknown := set(raw) - {*lists, "secrets", "limits"}:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    out = Config(**{n: [_make(k, v, n) for v in raw.get(n, [])] for n, k in lists.items()}, secrets=_make(Secrets, raw.get("secrets", {}), "secrets"), limits=_make(Limits, raw.get("limits", {}), "limits"))
    if out.secrets.policy not in ("redact", "preserve"):
        raise ValueError(f"secrets.policy: {out.secrets.policy!r}")
    return out
