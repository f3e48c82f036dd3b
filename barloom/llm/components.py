"""Connected components of a graph of links, by alternating large and small stars.

Each round replaces the links of every node by links to the least node in reach, first for larger
neighbours, then for smaller ones, until the links form stars. Links stay a distributed table and
are written after each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release

#: Links up to which a round is one task, as its shuffles would cost far more than its work.
FEW_LINKS = 10_000


def _least(both: DataFrame) -> DataFrame:
    """Links u, v in both directions, with the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).drop("w")


def _are_stars(edges: DataFrame, together: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether every node u has one link, to a node v that has none of its own. Each v, always less than its u, is then the least of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("top")))
    return not together(ends).groupBy("node").agg((F.sum("up") + F.max("top")).alias("n")).where("n > 1").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) for every node with a link.

    links: a, b, a table that is cut, as it is counted first. Loops and repeated links do no harm;
    without links the result is empty. Rounds go on until the links form stars; their number grows
    with the logarithm of the number of links.
    """
    n = links.count()
    together = (lambda df: df.coalesce(1)) if n <= FEW_LINKS else (lambda df: df)
    edges = cut(together(links).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n)
    while not _are_stars(edges, together):
        both = together(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u keeps its smaller neighbours and itself, all linked to the least
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select("v", "m").where("v <> m")
        before, edges = edges, cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * n)
        release(before)
    tops = together(edges).select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = cut(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops), 2 * n)
    release(edges)
    return out
