"""Connected components of links between nodes, by alternating stars.

Every node repeatedly links its larger neighbours, then its smaller ones, to the smallest neighbour it has, until each component is a star around its smallest node. Rounds grow with the logarithm of the nodes;
each is cut off by a written table, and nothing but one row reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.shared import hot_safe_join, written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = hot_safe_join(both, least, ["u"])
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links point from the larger node u to the smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = hot_safe_join(links, least, ["u"])
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one, or only links to larger ones."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("leaf")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("leaf")))
    roles = ends.groupBy("node").agg(F.sum("leaf").alias("leaves"), F.min("leaf").alias("least"))
    return roles.where("leaves > 1 or (leaves = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; `links` has long columns u and v. The root is the smallest node."""
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _are_stars(now):
        now = written(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
