"""Connected components of a link table, as Spark jobs.

Union-find over a distributed table: the alternating large-star and small-star
steps (Kiveris et al., "Connected Components in MapReduce and Beyond") hang every
node under the smallest node it knows until nothing changes.  A step is a grouped
minimum, which is merged in the map tasks, and an equi-join, whose hot keys Spark
splits; no task holds a component.  Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import staged


def _hang(links: DataFrame) -> DataFrame:
    """``u, v, m``: the links with the smallest node among u and its partners v."""
    low = links.groupBy("u").agg(F.min("v").alias("low"))
    low = staged(low.select(F.col("u").alias("m_u"), F.least("u", "low").alias("m")), "lowest")
    return links.join(low, F.col("u") == F.col("m_u")).drop("m_u")


def _settled(edges: DataFrame) -> bool:
    """Whether every child ``u`` has one parent ``v``, which is no child itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node reachable) for every node of ``links`` (``a, b``, longs)
    that is not itself a root."""
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_hang(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        hung = _hang(large)
        own = hung.select("u", F.col("m").alias("v"))
        others = hung.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(own.unionByName(others).distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
