"""Connected components of a link table by alternating star contractions, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def _settled(e: DataFrame) -> bool:
    """Whether every node above another is so once, and none of those is below it: stars and nothing else."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): ``comp`` is the least node reachable.

    A node's neighbours are never gathered: each star step takes a minimum per node and joins it back, so a
    node with any number of links is spread by the join. Rounds grow with the logarithm of the longest path
    and go on until only stars are left, however many that takes.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _settled(e):
        # large star: every neighbour above a node goes to the least node around it
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = cut(up.where("u <> v").distinct())
        # small star: every neighbour below a node, and the node, go to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        down = big.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, cut(down.union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        discard(before, big)
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
