"""The functions of ids, times, paths, parts and names over rows made of the test tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, paths, times
from ..functions.parts import PART, content_fingerprint, searchable
from ..operators import identity
from ..sources import attachments, repository
from .records import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey")


def rfc3339_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times written with offsets, fractions and separators of several kinds and read back; every seventh names a day that doesn't exist or no offset."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    n = F.col("event_id")
    shifted = F.col("ts") + F.make_interval(hours=F.when(n % 3 == 1, 5).when(n % 3 == 2, -3).otherwise(0))
    zone = F.when(n % 3 == 1, "+05:00").when(n % 3 == 2, "-0300").otherwise("Z")
    day = F.date_format(shifted, "yyyy-MM-dd")
    clock = F.date_format(shifted, "HH:mm:ss")
    micros = F.lpad(F.pmod(F.unix_micros("ts"), F.lit(1_000_000)).cast("string"), 6, "0")
    text = F.concat(F.when(n % 14 == 7, "2023-02-29").otherwise(day), F.when(n % 2 == 0, "T").otherwise(" "), clock, F.when(n % 4 == 1, ",").otherwise("."), micros, F.when(n % 14 == 0, "").otherwise(zone))
    return e.select("event_id", times.parse_rfc3339(text).alias("ts_ns"), times.to_rfc3339(times.parse_rfc3339(text)).alias("text"), times.to_rfc3339(F.unix_seconds("ts") * 1_000_000_000).alias("whole"), times.to_rfc3339(F.unix_seconds("ts") * 1_000_000_000, fixed=True).alias("fixed"))


def takeout_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated lines as an activity page shows them, English with half days and a zone, or Portuguese."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    months = F.element_at(F.split(F.lit("jan,fev,mar,abr,mai,jun,jul,ago,set,out,nov,dez"), ","), F.month("ts"))
    english = F.concat(F.date_format("ts", "MMM d, yyyy, h:mm:ss a"), F.lit(" EST"))
    other = F.concat(F.dayofmonth("ts").cast("string"), F.lit(" de "), months, F.lit(". de "), F.date_format("ts", "yyyy, HH:mm:ss"), F.lit(" BRT"))

    @F.pandas_udf("string")
    def read(text: pd.Series) -> pd.Series:
        from ..sources.exports import takeout_time

        return text.map(takeout_time)

    return e.select("event_id", read(F.when(F.col("event_id") % 2 == 0, english).otherwise(other)).alias("time"))


def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids can stand for a record anywhere: UUIDs, long hex, long and mixed, and five kinds that can't."""
    k = F.col("o_orderkey")
    hexed = F.md5(k.cast("string"))
    uuid = F.concat_ws("-", F.substring(hexed, 1, 8), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12))
    made = F.when(k % 8 == 0, uuid).when(k % 8 == 1, hexed).when(k % 8 == 2, F.concat(F.lit("msg_abcdefghijkl"), k.cast("string"), F.lit("0123456789"))).when(k % 8 == 3, k.cast("string")).when(k % 8 == 4, F.lit("turn")).when(k % 8 == 5, F.repeat(F.lit("ab1"), 10)).when(k % 8 == 6, F.lit(None).cast("string")).otherwise(F.substring(hexed, 1, 15))
    return _orders(spark, sf_dir).select("o_orderkey", ids.is_globally_unique(made).alias("is_unique"))


def conversation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys conversations get by the ids they have: unique ones their own, others of an application share one, those without any go by the fallback."""
    k = F.col("o_orderkey")
    native = F.when(k % 4 == 0, F.md5(k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("c"), k.cast("string")))
    session = F.when(k % 4 == 2, F.md5(F.concat(F.lit("s"), (k % 100).cast("string"))))
    key = ids.conversation_key(F.lit("p"), F.concat(F.lit("app"), (k % 3).cast("string")), native, session, [(k % 50).cast("string")])
    return _orders(spark, sf_dir).groupBy((k % 4).alias("kind")).agg(F.countDistinct(key).alias("conversations"), F.min(F.length(key)).alias("size"))


def event_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the evidence of their identity, and how many ids they get."""
    k = F.col("o_orderkey")
    native = F.when(k % 4 == 0, F.md5(k.cast("string"))).when(k % 4 == 1, (k % 200).cast("string")).when(k % 4 == 2, F.lit(""))
    event_id, tier = ids.event_identity(F.lit("p"), F.lit("a"), F.concat(F.lit("cv_"), (k % 3).cast("string")), native, (k % 10).cast("long"), F.lit("user"), F.lit("message"), F.lit("fp"))
    return _orders(spark, sf_dir).select(tier.alias("tier"), event_id.alias("id")).groupBy("tier").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("id").alias("ids"))


#: Lengths of inputs (bytes 0, 1, ... 250, 0, ...) and the first 16 bytes of their published digests.
VECTORS = {0: "af1349b9f5f9a1a6a0404dea36dcc949", 1: "2d3adedff11b61f14c886e35afa03673"}


def blake3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published vectors of the hash, and digests of one text by columns and one by one."""
    from ..functions.blake3 import digests

    sizes = spark.createDataFrame([(n,) for n in VECTORS], "size int")

    @F.pandas_udf("string")
    def digest(size: pd.Series) -> pd.Series:
        return pd.Series([d.hex()[:32] for d in digests([bytes(k % 251 for k in range(n)) for n in size])], index=size.index)

    return sizes.select("size", digest("size").alias("digest"))


def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory in the spellings of five systems, with what they hint at and whether it lies below a root."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("Dir"), k.cast("string"))
    raw = F.when(k % 5 == 0, F.concat(F.lit("C:\\Users\\Me\\"), name, F.lit("\\"))).when(k % 5 == 1, F.concat(F.lit("/mnt/c/Users/Me/"), name)).when(k % 5 == 2, F.concat(F.lit("/home/me/"), name, F.lit("//"))).when(k % 5 == 3, F.concat(F.lit("\\\\?\\UNC\\Host\\Share\\"), name)).otherwise(F.concat(F.lit("/Users/me/"), name))
    path = paths.normalize_path(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", path.alias("path"), paths.platform_hint(raw).alias("platform"), paths.basename(raw).alias("name"), paths.path_within(path, F.lit("c:/users/me")).alias("inside"))


def remote_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One remote in four spellings."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Repo"), k.cast("string"))
    url = F.when(k % 4 == 0, F.concat(F.lit("git@Host.org:Own/"), name, F.lit(".git"))).when(k % 4 == 1, F.concat(F.lit("ssh://git@host.org:22/Own/"), name)).when(k % 4 == 2, F.concat(F.lit("https://user:pw@host.org/Own//"), name, F.lit("/"))).otherwise(F.concat(F.lit("https://host.org/Own/"), name, F.lit(".git")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", paths.normalize_remote(url).alias("remote"))


def mapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were copied from another machine under their paths there."""
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 3 == 0, "/stage/m1/").when(k % 3 == 1, "/stage/m10/").otherwise("/other/"), k.cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", paths.mapped_path(path, "/stage/m1/", "host:/home/me").alias("path"))


def machine_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first configured rule whose prefix holds a path."""
    rules = spark.createDataFrame([(0, "/home/me/Dir1", "one"), (1, "C:\\Users", "two"), (2, "/home", "three"), (3, "/home/me", "four")], "ord int, prefix string, machine string")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.concat(F.lit("c:/users/x"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("/home/me/Dir"), (k % 40).cast("string"))).alias("path"))
    return identity.by_prefix(rows, rules, path_col="path", value_col="machine", into="machine").select("c_custkey", "machine")


def project_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by an alias of the path, else the repository, else the path."""
    aliases = spark.createDataFrame([(0, "/w/d1", "alias")], "ord int, prefix string, project string")
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 != 3, F.concat(F.lit("/w/d"), (k % 4).cast("string"))).alias("working_directory"), F.when(k % 2 == 0, F.concat(F.lit("git@h.org:o/r"), (k % 8).cast("string"), F.lit(".git"))).alias("remote"))
    done = identity.projects(rows, aliases)
    return done.groupBy("project_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("project_id").alias("projects"), F.countDistinct("repository_id").alias("repositories"))


def git_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remotes of directories inside repositories (a worktree among them), read from files that are written here."""
    from pathlib import Path

    from ..lineage import kept
    from ..sources.ingest import local

    nations = table(spark, sf_dir, "nation").select("n_nationkey")

    def build(folder: str) -> str:
        root = local(folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    own = Path(root, f"r{k}")
                    (own / "a/b").mkdir(parents=True, exist_ok=True)
                    git = own / "main.git" if k % 5 == 4 else own / ".git"
                    git.mkdir(exist_ok=True)
                    (git / "config").write_text(f'[core]\n\tbare = false\n[remote "origin"]\n\turl = https://host.org/n{k}.git\n[remote "other"]\n\turl = x\n' if k % 5 != 3 else "[core]\n")
                    if k % 5 == 4:
                        (own / ".git").write_text(f"gitdir: {git}\n")
                yield b

        nations.mapInArrow(run, nations.schema).count()
        return root

    root = kept(spark, ("git", sf_dir), build)
    rows = nations.withColumn("dir", F.concat(F.lit(f"{root}/r"), F.col("n_nationkey").cast("string"), F.lit("/a/b")))
    return rows.join(repository.remotes(rows, path_col="dir"), "dir", "left").select("n_nationkey", "remote")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    some = lambda **v: F.struct(*[(v[f.name] if f.name in v else F.lit(None)).cast(f.dataType).alias(f.name) for f in PART.fields])
    content = F.array(
        some(type=F.lit("text"), text=F.col("text")),
        some(type=F.lit("tool_call"), id=F.lit("c"), name=F.lit("ls"), arguments_json=F.lit('{"a":1}')),
        some(type=F.lit("tool_result"), tool_call_id=F.lit("c"), output_json=F.lit('"out"'), is_error=F.lit(False)),
        some(type=F.lit("opaque"), kind=F.lit("k"), note=F.lit("n")),
        some(type=F.lit("file_ref"), path=F.lit("p.txt")),
    )
    return turns.select("conv_id", "turn", content.alias("content"))


def searchable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search sees of parts of five kinds."""
    return _parts(spark, sf_dir).select("conv_id", "turn", F.sha2(searchable(F.col("content")), 256).alias("text_sha256"))


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many fingerprints as different contents."""
    return _parts(spark, sf_dir).agg(F.countDistinct(content_fingerprint(F.col("content"))).alias("fingerprints"), F.count(F.lit(1)).alias("turns"))


def mime_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks.files import guess_mime

    k = F.col("o_orderkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".jpeg", ".pdf", ".md", "", ".xyz", ".tar.zip")]), (k % 7).cast("int") + 1))
    return _orders(spark, sf_dir).groupBy(guess_mime(name).alias("mime")).agg(F.count(F.lit(1)).alias("n"))


def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a heading, emphasis, a link, lists, code and a table, as Markdown."""
    from .content import markdown_of

    k = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit("<html><head><title>no</title></head><h2>N"), k, F.lit("</h2><p>a &amp; <b>b</b>  <i>c</i> <a href='u"), k, F.lit("'>d</a></p><ul><li>x<li>y</ul><ol><li>one<li>two</ol><pre>k  k</pre><p><code>z</code></p><table><tr><th>h<th>i</tr><tr><td>1<td>2</tr></table><script>no</script>"))
    return markdown_of(table(spark, sf_dir, "nation").select("n_nationkey", html.alias("html")), id_col="n_nationkey", html_col="html")


def attachment_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages resolved against an export's members, by name and with either ending of JPEG files."""
    k = F.col("n_nationkey").cast("string")
    html = F.concat(F.lit('<img src="img/a%20'), k, F.lit('.JPEG"><a href="doc'), k, F.lit('.pdf#p">x</a><a href="https://h/doc.pdf">y</a><img src="lost.png"><img src="lost.png">'))
    nations = table(spark, sf_dir, "nation")
    members = nations.select(F.concat(F.lit("Takeout/img/a "), k, F.lit(".jpg")).alias("path")).unionByName(nations.where("n_nationkey % 2 = 0").select(F.concat(F.lit("Takeout/doc"), k, F.lit(".pdf")).alias("path")))
    return attachments.resolve(nations.select("n_nationkey", html.alias("html")), members, id_col="n_nationkey", html_col="html")


def unsupported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are known and not imported, by their format."""
    from ..sources import registry

    names = ["/h/.claude/todos/x.json", "/h/x.db-wal", "/h/.codex/auth.json", "/e/user.json", "/e/chat.html", "/e/projects/p.json", "/t/Gemini Apps/a.png", "/t/Gemini Apps/MyActivity.html", "/e/file-1.png", "/h/AnthropicClaude/app-1/x.bin", "/e/conversations.json", "/h/a.txt"]
    k = F.col("o_orderkey")
    path = F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int") + 1)

    @F.pandas_udf("string")
    def known(path: pd.Series) -> pd.Series:
        return path.map(lambda p: (registry.unsupported(p, b'{"prompt_template":1}') or (None,))[0])

    return _orders(spark, sf_dir).groupBy(known(path).alias("format")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        rfc3339_times, takeout_times, unique_ids, conversation_keys, event_tiers, blake3_vectors, path_forms, remote_forms, mapped_paths, machine_rules, project_rules, git_remotes, searchable_texts, content_fingerprints, mime_types, html_to_markdown,
        attachment_members, unsupported_files,
    )
}
_SHOWN = """replace('## N' || n_nationkey || '@@a & **b** *c* [d](u' || n_nationkey || ')@- x@- y@@1. one@2. two@@```@k  k@```@@`z`@@| h | i |@|---|---|@| 1 | 2 |', '@', chr(10))"""
SQL = {
    "rfc3339_times": """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s FROM events),
      r AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN us * 1000 END AS ns FROM e)
      SELECT event_id, ns AS ts_ns, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || CASE WHEN ns IS NULL THEN NULL WHEN ns % 1000000000 = 0 THEN '' ELSE '.' || lpad((ns % 1000000000)::VARCHAR, 9, '0') END || 'Z' AS text,
        strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%SZ') AS whole, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S') || '.000000000Z' AS fixed FROM r""",
    "takeout_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN event_id % 2 = 0 THEN '-05:00' ELSE '-03:00' END AS time FROM events",
    "unique_ids": "SELECT o_orderkey, o_orderkey % 8 IN (0, 1, 2) AS is_unique FROM orders",
    "conversation_keys": """SELECT o_orderkey % 4 AS kind, count(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN o_orderkey::VARCHAR || '/' || o_orderkey % 3 WHEN 1 THEN (o_orderkey % 3)::VARCHAR WHEN 2 THEN (o_orderkey % 100)::VARCHAR || '/' || o_orderkey % 3
        ELSE (o_orderkey % 50)::VARCHAR || '/' || o_orderkey % 3 END) AS conversations, 27 AS size FROM orders GROUP BY 1""",
    "event_tiers": """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'coordinates' ELSE 'fingerprint' END AS tier FROM orders)
      SELECT tier, count(*) AS events, count(DISTINCT CASE tier WHEN 'native' THEN k::VARCHAR WHEN 'coordinates' THEN k % 3 || '/' || k % 200 ELSE k % 3 || '/' || k % 10 END) AS ids FROM t GROUP BY tier""",
    "blake3_vectors": "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{d}')" for n, d in VECTORS.items()) + ") t(size, digest)",
    "path_forms": r"""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'c:/users/me/dir' WHEN 1 THEN 'c:/users/me/dir' WHEN 2 THEN '/home/me/Dir' WHEN 3 THEN '//host/share/dir' ELSE '/Users/me/Dir' END || c_custkey AS path,
      CASE c_custkey % 5 WHEN 0 THEN 'windows' WHEN 1 THEN 'linux' WHEN 2 THEN 'linux' WHEN 3 THEN 'windows' ELSE 'macos' END AS platform, 'Dir' || c_custkey AS name, c_custkey % 5 IN (0, 1) AS inside FROM customer""",
    "remote_forms": "SELECT s_suppkey, 'host.org/own/repo' || s_suppkey AS remote FROM supplier",
    "mapped_paths": "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'host:/home/me/' WHEN 1 THEN '/stage/m10/' ELSE '/other/' END || s_suppkey AS path FROM supplier",
    "machine_rules": "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'two' WHEN 1 THEN CASE WHEN c_custkey % 40 = 1 THEN 'one' ELSE 'three' END END AS machine FROM customer",
    "project_rules": """WITH r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey % 8 END AS repo, CASE WHEN c_custkey % 4 = 1 THEN 'alias' WHEN c_custkey % 2 = 0 THEN 'r' || c_custkey % 8 END AS name FROM customer)
      SELECT name AS project_name, count(*) AS n, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS projects, count(DISTINCT repo) AS repositories FROM r GROUP BY name""",
    "git_remotes": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 <> 3 THEN 'https://host.org/n' || n_nationkey || '.git' END AS remote FROM nation",
    "searchable_texts": """SELECT conv_id, turn, sha256(CASE WHEN text = '' THEN '' ELSE text || chr(10) END || 'ls {"a":1}' || chr(10) || '"out"' || chr(10) || '[k] n' || chr(10) || 'p.txt') AS text_sha256 FROM conversations""",
    "content_fingerprints": "SELECT count(DISTINCT text) AS fingerprints, count(*) AS turns FROM conversations",
    "mime_types": "SELECT CASE o_orderkey % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'text/markdown' WHEN 6 THEN 'application/zip' END AS mime, count(*) AS n FROM orders GROUP BY 1",
    "html_to_markdown": f"SELECT n_nationkey, {_SHOWN} AS markdown FROM nation",
    "attachment_members": """SELECT n_nationkey, 'img/a ' || n_nationkey || '.JPEG' AS reference, 'Takeout/img/a ' || n_nationkey || '.jpg' AS member FROM nation
      UNION ALL SELECT n_nationkey, 'doc' || n_nationkey || '.pdf', CASE WHEN n_nationkey % 2 = 0 THEN 'Takeout/doc' || n_nationkey || '.pdf' END FROM nation UNION ALL SELECT n_nationkey, 'lost.png', NULL FROM nation""",
    "unsupported_files": """SELECT ['claude_code_state', 'sqlite_companion', 'codex_state', 'chatgpt_export_account', 'chatgpt_html', 'claude_export_projects', 'takeout_attachment', NULL, 'chatgpt_export_attachment', 'desktop_installation', 'unknown_web_export', NULL][o_orderkey % 12 + 1] AS format,
      count(*) AS n FROM orders GROUP BY 1""",
}
