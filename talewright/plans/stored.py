"""Files, archives, shards and packs written from the test tables and read back."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import kept
from ..sinks import files
from ..sources import ingest
from .records import table


def _page_files(spark: SparkSession, sf_dir: str) -> str:
    """Each page as a file (every tenth empty, every seventh with an unwanted ending, every eleventh a LevelDB store, every thirteenth in a folder that is passed over)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")

    def build(folder: str) -> str:
        root = ingest.local(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    own = Path(root, f"d{k % 3}", f"p{k}")
                    if k % 11 == 0:
                        for name in ("CURRENT", "MANIFEST-1", "1.ldb"):
                            files.write_atomic(own / name, html.encode())
                    elif k % 13 == 0:
                        files.write_atomic(own / "node_modules" / "x.html", b"x")
                    else:
                        files.write_atomic(own / ("x.png" if k % 7 == 0 else "x.html"), b"" if k % 10 == 0 else html.encode())
                yield pa.RecordBatch.from_arrays([b.column(0)], names=["page_id"])

        pages.mapInArrow(run, "page_id long").count()
        Path(root, "link").symlink_to(root)
        return root

    return kept(spark, ("pages", sf_dir), build)


def surveyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk finds, and why some of it isn't read."""
    listed = ingest.listing(spark, [_page_files(spark, sf_dir)])
    return listed.select(F.regexp_extract("path", r"/p(\d+)", 1).try_cast("long").alias("page_id"), F.when(~F.col("problem").eqNullSafe(F.lit("link")), F.col("size")).alias("size"), "problem")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many sources and fingerprints as files, the same at a second look."""
    root = _page_files(spark, sf_dir)
    both = ingest.listing(spark, [root]).unionByName(ingest.listing(spark, [root, root])).where("problem is null")
    return both.agg(F.countDistinct("fingerprint").alias("fingerprints"), F.countDistinct("source_id").alias("sources"), F.count(F.lit(1)).alias("rows"))


def archived_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in packages: plain zip, a zip in a compressed tar, and single files in gzip and zstd; with a member whose path leaves its folder."""
    groups = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 40).alias("g")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("docs"))

    def package(g: int, docs: list[dict]) -> tuple[str, bytes]:
        if g % 4 in (2, 3):
            import zstandard

            body = "\n".join(d["text"] for d in docs).encode()
            return (f"g{g}.txt.gz", gzip.compress(body)) if g % 4 == 2 else (f"g{g}.txt.zst", zstandard.compress(body))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for d in docs:
                z.writestr(f"docs/doc-{d['doc_id']}.txt", d["text"])
            z.writestr("../evil.txt", "x")
        if g % 4 == 0:
            return f"g{g}.zip", out.getvalue()
        tar = io.BytesIO()
        with tarfile.open(fileobj=tar, mode="w") as t:
            info = tarfile.TarInfo("in.zip")
            info.size = len(out.getvalue())
            t.addfile(info, io.BytesIO(out.getvalue()))
        return f"g{g}.tar.gz", gzip.compress(tar.getvalue())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        from ..sources import archives

        for b in batches:
            rows = []
            for g, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name, data = package(g, docs)
                rows += [(g, m.path, len(m.chain), None if m.data is None else hashlib.sha256(m.data).hexdigest()) for m in archives.members(name, data)]
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, (pa.int64(), pa.string(), pa.int64(), pa.string()))], names=["g", "path", "depth", "sha256"])

    return groups.mapInArrow(run, "g long, path string, depth long, sha256 string")


def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as compressed shards and back, with a line that is no record."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")

    def build(folder: str) -> str:
        root = ingest.local(folder)
        files.write_shards(e, f"{root}/a").agg(F.sum("records")).collect()
        files.stream_lines(iter(["{broken"]), f"{root}/b", "part-x")
        return root

    back = files.read_shards(spark, kept(spark, ("shards", sf_dir), build), e.schema)
    return back.select(*e.columns, F.col("_corrupt").isNotNull().alias("corrupt"))


def packed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files in a pack, unpacked elsewhere, with the checksums of what is there then."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    def build(folder: str) -> str:
        root = ingest.local(folder)
        for r in nations.collect():  # as many as there are nations
            files.write_atomic(f"{root}/in/d{r.n_nationkey % 3}/{r.n_nationkey}.txt", r.n_name.encode())
        files.pack(f"{root}/in", f"{root}/a.pack")
        files.unpack(f"{root}/a.pack", f"{root}/out")
        return f"{root}/out"

    return files.checksums(spark, kept(spark, ("pack", sf_dir), build))


def array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of JSON arrays one by one, an element that is no JSON among them."""
    groups = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 30).alias("g")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.lines import elements

        for b in batches:
            rows = []
            for g, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = "[" + ", ".join(f'{{"k": {k}}}' for k in keys) + (", broken]" if g % 3 == 0 else "]")
                rows += [(g, n, None if error else v["k"]) for n, v, error in elements(raw.encode())]
            c = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names=["g", "n", "k"])

    return groups.mapInArrow(run, "g long, n long, k long")


QUERIES = {f.__name__: f for f in (surveyed_files, fingerprints, archived_members, shard_round_trip, packed_files, array_elements)}
SQL = {
    "surveyed_files": """SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 3 * strlen(html) WHEN page_id % 10 = 0 THEN 0 ELSE strlen(html) END::BIGINT AS size,
        CASE WHEN page_id % 11 = 0 THEN 'leveldb' WHEN page_id % 10 = 0 THEN 'empty' WHEN page_id % 7 = 0 THEN 'extension' END AS problem FROM pages WHERE page_id % 13 <> 0 OR page_id % 11 = 0
      UNION ALL SELECT NULL, NULL, 'link'""",
    "fingerprints": "SELECT count(*) AS fingerprints, count(*) AS sources, 2 * count(*) AS rows FROM pages WHERE page_id % 13 <> 0 AND page_id % 11 <> 0 AND page_id % 10 <> 0 AND page_id % 7 <> 0",
    "archived_members": """WITH d AS (SELECT doc_id % 40 AS g, doc_id, text FROM documents)
      SELECT g, 'docs/doc-' || doc_id || '.txt' AS path, CASE WHEN g % 4 = 0 THEN 1 ELSE 3 END AS depth, sha256(text) AS sha256 FROM d WHERE g % 4 < 2
      UNION ALL SELECT g, '../evil.txt', CASE WHEN g % 4 = 0 THEN 1 ELSE 3 END, NULL FROM d WHERE g % 4 < 2 GROUP BY g
      UNION ALL SELECT g, 'g' || g || '.txt', 1, sha256(string_agg(text, chr(10) ORDER BY doc_id)) FROM d WHERE g % 4 > 1 GROUP BY g""",
    "shard_round_trip": "SELECT event_id, user_id, event_type, value, props, false AS corrupt FROM events UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true",
    "packed_files": "SELECT 'd' || n_nationkey % 3 || '/' || n_nationkey || '.txt' AS path, sha256(n_name) AS sha256 FROM nation",
    "array_elements": """WITH o AS (SELECT o_orderkey % 30 AS g, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderkey % 30 ORDER BY o_orderkey) - 1 AS n FROM orders)
      SELECT g, n, k FROM o UNION ALL SELECT g, count(*), NULL FROM o WHERE g % 3 = 0 GROUP BY g""",
}
