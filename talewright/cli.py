"""python -m talewright.cli COMMAND: a thin front to the library. Exit 1: a check failed; 2: an error."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from . import config, session
from .archive import Archive
from .sinks import files
from .sources import ingest, local_stores, registry


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="talewright")
    sub = p.add_subparsers(dest="command", required=True)
    one = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(a, **k) for a, k in args]
    folder, event = ("archive", {}), ("event_id", {})
    one("discover", ("paths", {"nargs": "*"}), ("--local", {"action": "store_true", "help": "the stores of known tools on this machine"}))
    one("inspect", ("paths", {"nargs": "+"}))
    one("import", ("paths", {"nargs": "+"}), ("-o", {"dest": "archive", "required": True}), ("--resume", {"action": "store_true"}), ("--dry-run", {"action": "store_true"}), ("--secret-policy", {"choices": ("redact", "preserve"), "default": None}), ("--config", {}), ("--only", {"choices": sorted(registry.BY_ID)}), ("--repositories", {"action": "store_true"}), ("--progress", {"action": "store_true"}))
    one("all", folder, ("--output", {"default": "-"}), ("--harness", {"action": "store_true"}), ("--stdout", {"action": "store_true"}), ("--compress", {"action": argparse.BooleanOptionalAction, "default": None}), ("--shards", {"action": "store_true", "help": "a folder of files instead of one"}))
    for name in ("validate", "stats", "report", "rebuild-index", "dataset"):
        one(name, folder)
    one("search", folder, ("query", {}), ("--limit", {"type": int, "default": 20}))
    one("provenance", folder, event)
    one("inspect-event", folder, event)
    one("pack", folder, ("target", {}))
    one("unpack", ("source", {}), ("target", {}), ("--force", {"action": "store_true"}))
    one("parsers", ("--inspect", {"metavar": "FILE", "help": "which of them take a file, and how well"}))
    a = p.parse_args(argv)
    show = lambda df: [print(line) for line in df.toJSON().toLocalIterator()]
    try:
        if a.command == "parsers":
            if a.inspect:
                with open(a.inspect, "rb") as f:
                    head = f.read(registry.PROBE)
                print("\n".join(f"{x.id}\t{x.detect(a.inspect, head)}" for x in registry.PARSERS))
                return 0
            print("\n".join(f"{x.id}\t{x.provider}/{x.application}" for x in registry.PARSERS))
            return 0
        if a.command == "pack":
            print(files.pack(a.archive, a.target))
            return 0
        if a.command == "unpack":
            print("\n".join(files.unpack(a.source, a.target, force=a.force)))
            return 0
        if a.command in ("discover", "inspect"):
            stores = local_stores.candidates(os.environ) if getattr(a, "local", False) else ()
            for root in [*a.paths, *(path for _, path in stores)]:
                for path, size, _, problem in ingest.survey(root):
                    if problem:
                        print(path, size, problem, 0, sep="\t")
                        continue
                    with open(path, "rb") as f:
                        found = registry.detect(path, f.read(registry.PROBE))
                    for parser, score in found[: 1 if a.command == "discover" else None] or [(None, 0)]:
                        print(path, size, parser.id if parser else registry.unsupported(path) or "-", score, sep="\t")
            return 0
        settings = None
        if getattr(a, "config", None):
            with open(a.config) as f:
                settings = config.load(f.read())
        spark = session.local(**{"spark.ui.showConsoleProgress": str(getattr(a, "progress", False)).lower()})
        archive = Archive(spark, a.archive, settings)
        if a.command == "import":
            if a.secret_policy:
                archive.config.secrets.policy = a.secret_policy
            show(archive.import_(a.paths, resume=a.resume, dry_run=a.dry_run, only=a.only, repositories=a.repositories))
            if not a.dry_run:
                archive.write_dataset()
            return 0 if a.dry_run else int(archive.validate().where("not passed").count() > 0)
        if a.command == "all":
            lines = archive.harness_lines() if a.harness else archive.records().select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
            target = "-" if a.stdout else a.output
            if a.shards:
                lines.write.mode("error").option("compression", "zstd" if files.compressed(target, harness=a.harness, flag=a.compress) else "none").text(target)
            else:
                files.write_single(lines, target, compress=files.compressed(target, harness=a.harness, flag=a.compress))
            return 0
        if a.command == "rebuild-index":
            print(archive.rebuild_index())
            return 0
        if a.command == "dataset":
            print(json.dumps(archive.write_dataset()["counts"]))
            return 0
        if a.command == "validate":
            checks = archive.validate()
            show(checks)
            return int(checks.where("not passed").count() > 0)
        if a.command == "report":
            for name, lines in archive.report_lines().items():
                files.write_lines(f"{a.archive}/reports/{name}", lines)
            return 0
        show(archive.stats() if a.command == "stats" else archive.search(a.query, a.limit) if a.command == "search" else archive.provenance(a.event_id) if a.command == "provenance" else archive.inspect_event(a.event_id))
        return 0
    except (OSError, ValueError, LookupError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
