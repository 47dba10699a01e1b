"""Connected components of a distributed set of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, saved


def stars_only(links: DataFrame) -> bool:
    """Whether distinct links from u to smaller v are stars around their smallest nodes: each u has one v, and no v is a u. A
    further round would leave them as they are."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.agg(F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node that can be reached) of every node with a link.

    Each round turns every node's neighbourhood into a star around its smallest member; rounds grow as the logarithm of
    the longest chain. Links may be given in any direction and repeatedly; a link of a node with itself and links with
    nulls are ignored. Hot nodes are dealt out by salts; each round is written to the shared folder.
    """
    links = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = saved(links, "links")
    while not stars_only(links):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        stars = attach(both, "u", "v", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m"))
        small = attach(stars, "u", "v", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = saved(small.union(least.select("u", "m")).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
