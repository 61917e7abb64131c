"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``label``, the smallest node reachable, of all nodes with links.

    ``links`` has the columns ``a`` and ``b``. Large-star and small-star steps by turns: every
    node hands its larger (then all) neighbours to its smallest one, until the links are stars
    around the smallest nodes. The number of steps grows with the logarithm of the longest
    path. Every step is written to the scratch folder. A star's hub is met by a join that Spark
    may split, and the minimum of its neighbours is combined before it is shuffled.
    """
    edges = scratch.keep("edges", links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep("edges", small.unionByName(
            least.select("u", F.col("m").alias("v"))).distinct())
        # Stars around the smallest nodes: no node has two links up, or is both hub and leaf.
        roles = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("hub")).unionByName(
            edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("hub")))
        if roles.groupBy("u").agg(F.sum("up").alias("up"), F.max("hub").alias("hub")).where(
                "up > 1 or (up = 1 and hub = 1)").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
