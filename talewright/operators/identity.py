"""Which machine, repository and project an event belongs to, by configured rules and its paths.

Rules come from configuration, so they are few; their number is checked before they are joined by broadcast, and beyond
the bound the prefixes of each path are joined to the rules' paths instead, which needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import id_of
from ..functions.paths import basename, normalize_path, normalize_remote, path_within

BROADCAST_RULES = 10_000


def by_prefix(df: DataFrame, rules: DataFrame, *, path_col: str, value_col: str, into: str) -> DataFrame:
    """df with `into`: the value of the first rule (by ord) whose prefix holds the path.

    rules(ord, prefix, <value_col>). Distinct paths are matched, not rows.
    """
    known = rules.select("ord", normalize_path(F.col("prefix")).alias("prefix"), F.col(value_col).alias("v")).where("prefix != ''")
    count = known.limit(BROADCAST_RULES + 1).count()
    if not count:
        return df.withColumn(into, F.lit(None).cast("string"))
    paths = df.select(F.col(path_col).alias("raw")).where("raw is not null").distinct().withColumn("path", normalize_path(F.col("raw")))
    if count <= BROADCAST_RULES:
        hit = paths.join(F.broadcast(known), path_within(F.col("path"), F.col("prefix")))
    else:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        each = paths.select("raw", F.explode(F.array_distinct(F.transform(above, lambda p: F.when(p == "", "/").otherwise(p)))).alias("prefix"))
        hit = each.join(known.withColumn("prefix", F.when(F.length("prefix") > 1, F.regexp_replace("prefix", "/+$", "")).otherwise(F.col("prefix"))), "prefix")
    best = hit.groupBy(F.col("raw").alias(path_col)).agg(F.min_by("v", "ord").alias(into))
    return df.drop(into).join(best, path_col, "left")


def projects(df: DataFrame, aliases: DataFrame, *, path_col: str = "working_directory", remote_col: str = "remote") -> DataFrame:
    """df with repository_id, project_id and project_name: an alias of the path, else the repository, else the path."""
    remote = normalize_remote(F.col(remote_col))
    out = by_prefix(df, aliases, path_col=path_col, value_col="project", into="alias")
    out = out.withColumn("repository_id", F.when(F.coalesce(F.col(remote_col), F.lit("")) != "", id_of("repo_", remote)))
    path = normalize_path(F.col(path_col))
    out = out.withColumn(
        "project_id",
        F.when(F.col("alias").isNotNull(), id_of("prj_", "alias", F.col("alias"))).when(F.col("repository_id").isNotNull(), id_of("prj_", "repo", F.col("repository_id"))).when(path.isNotNull(), id_of("prj_", "path", path)),
    )
    return out.withColumn("project_name", F.coalesce("alias", F.when(F.col("repository_id").isNotNull(), basename(remote)), basename(path))).drop("alias")
