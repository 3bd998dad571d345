"""URL filter by host-suffix and path-prefix rules, in DataFrame operations only.

Each distinct URL is expanded into every (host suffix, path prefix) expression that
a rule could be; expressions meet the rules in an equi-join on four bytes of their
SHA-256, the full digest confirms the match, and the longest rule wins.

Cases: a null URL or one without ``://`` has an empty host and path, and no rule
fits an empty host. Repeated rows each get their verdict. Rules with a null field are
ignored; a rule that is given twice counts once; of rules of equal length the longer host wins,
then ``block``. An empty table gives an empty result. Columns named like a
result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, without

#: Rules are broadcast up to this many rows of at most a URL each; beyond it the join shuffles.
BROADCAST_RULES = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RESULT = ("host", "path", "rule", "verdict")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it has no ``://``."""
    rest = F.expr("''") if url is None else F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) -> one row for each, with digest and its first four bytes."""
    host = F.translate(F.col("host"), UPPER, UPPER.lower())
    return (
        rules.where("host is not null and path is not null and verdict is not null and host != ''")
        .groupBy(host.alias("r_host"), F.col("path").alias("r_path"))
        .agg(F.max("verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(_expression(F.col("r_host"), F.col("r_path"))))
        .withColumn("short", F.substring("r_digest", 1, 4))
    )


def judge(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; `default` is the verdict where no rule fits."""
    prepared = prepare_rules(rules)
    # Only prefixes as long as some rule's path can match; the list is bounded by the length of a URL.
    lengths = sorted(r[0] for r in prepared.select(F.length("r_path")).distinct().collect())
    if prepared.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        prepared = F.broadcast(prepared)
    kept = without(pages, *RESULT)
    key = "__url"
    while key in kept.columns:
        key += "_"
    kept = kept.withColumn(key, quoted(url_col).cast("string"))
    named, nameless = kept.where(F.col(key).isNotNull()), kept.where(F.col(key).isNull())  # null URLs don't meet in a task
    host, path = split_url(F.col(key))
    # a number of its own: the distinct URLs are few bytes, but each becomes many expressions
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = named.select(key).distinct().repartition(tasks, key).select(key, host.alias("u_host"), path.alias("u_path"))
    labels = F.split("u_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.expr("array(0)"), lambda n: n <= F.length("u_path"))
    prefixes = F.transform(sizes, lambda n: F.substring(F.col("u_path"), F.lit(1), n))
    expanded = (
        urls.where("u_host != ''")
        .withColumn("h", F.explode(F.filter(suffixes, lambda s: s != "")))
        .withColumn("p", F.explode(prefixes))
        .withColumn("digest", _digest(_expression(F.col("h"), F.col("p"))))
        .select(key, "digest", F.substring("digest", 1, 4).alias("short"))
    )
    hits = expanded.join(prepared, "short").where(F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict"))
    found = hits.groupBy(key).agg(F.max_by(F.struct("r_host", "r_path", "r_verdict"), rank).alias("hit"))
    rule = F.concat("hit.r_host", "hit.r_path")
    names = [quoted(c) for c in kept.columns if c != key]
    judged = named.join(found, key, "left").select(
        *names,
        host.alias("host"),
        path.alias("path"),
        rule.alias("rule"),
        F.coalesce(F.col("hit.r_verdict"), F.lit(default)).alias("verdict"),
    )
    empty = F.lit("")
    return judged.unionByName(nameless.select(*names, empty.alias("host"), empty.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")))
