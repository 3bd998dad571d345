"""Which members of an export the references in its HTML mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REFERENCE = r"""(?i)\b(?:href|src)\s*=\s*["']([^"'#?]+)"""


def references(html: Column) -> Column:
    """The distinct local names that a page refers to; addresses with a scheme aren't local."""
    found = F.transform(F.regexp_extract_all(html, F.lit(REFERENCE), 1), lambda r: F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))))
    return F.array_distinct(F.filter(found, lambda r: r.isNotNull() & ~r.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:|^//") & (r != "")))


def _name(path: Column) -> Column:
    """The last part of a path, in lower case, with one spelling of the two endings of JPEG files."""
    return F.regexp_replace(F.lower(F.element_at(F.split(path, "/"), -1)), r"\.jpeg$", ".jpg")


def resolve(pages: DataFrame, members: DataFrame, *, id_col: str, html_col: str) -> DataFrame:
    """(id, reference, member): the member (path) that each reference names, the first of several by path; null where there is none."""
    refs = pages.select(id_col, F.explode(references(F.col(html_col))).alias("reference")).withColumn("name", _name(F.col("reference")))
    known = members.withColumn("name", _name(F.col("path"))).groupBy("name").agg(F.min("path").alias("member"))
    return refs.join(known, "name", "left").select(id_col, "reference", "member")
