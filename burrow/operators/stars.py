"""Connected components by alternating stars.

Every round rewrites the links so that a node points at smaller ids: first all
larger neighbours of a node, then all smaller ones, are tied to the smallest.
The number of links never grows, a node's links are reduced to a minimum
before they are shuffled, and the rounds grow with the logarithm of the
longest chain, whatever the order of its ids. The minima are written before
they are joined, so that both sides of the join are plain exchanges and Spark
can split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burrow.session import materialise


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    smallest = materialise(smallest, "smallest")
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # Here every link points from the larger to the smaller node.
    smallest = materialise(links.groupBy("u").agg(F.min("v").alias("_m")), "smallest")
    tied = links.join(smallest, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return tied.unionByName(smallest.select("u", F.col("_m").alias("v"))).distinct()


def linked_components(links: DataFrame) -> DataFrame:
    """``u, component`` for every node of ``links`` (u, v) that is linked to
    another; the component is its smallest node. Links count both ways."""
    ordered = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = materialise(ordered, "links"), None
    while True:
        # At the fixed point every link points at the smallest node.
        row = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if row == mark or not row[0]:
            stars = now.select("u", F.col("v").alias("component"))
            return stars.unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
        mark, now = row, materialise(_small_star(materialise(_large_star(now), "links")), "links")
