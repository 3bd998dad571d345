"""Connected components of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label) for links(a, b): label is the least node of the component.

    Each round takes the least label among neighbours and then the label's own label, so chains
    shrink by half; rounds end when no label changes. Every round is a table in the shared
    folder. A node with very many links is split by adaptive execution; its minimum is added up before the shuffle.
    Null ends and links of a node to itself are ignored; an empty table gives an empty result.
    """
    some = links.select("a", "b").where("a is not null and b is not null and a != b")
    edges = cut(some.unionByName(some.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("lower"))
        own = labels.select(F.col("node").alias("lower"), F.col("label").alias("jump"))
        stepped = cut(lower.join(own, "lower", "left").select("node", F.col("label").alias("before"), F.least("lower", F.coalesce("jump", "lower")).alias("label")), "labels")
        labels = stepped.select("node", "label")
        if stepped.where("label != before").isEmpty():
            return labels
