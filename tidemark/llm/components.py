"""Connected components over a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace


def connected_components(links: DataFrame, work: Workspace, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each end of a link reaches.

    Links with a null end or with equal ends link nothing. A round writes the least neighbour of each node (a sum
    that is combined before its shuffle) and joins it back. Both sides of that join are plain reads, so Spark can
    split the rows of a node with very many links; no task gathers a node's neighbours. Rounds: about the logarithm
    of the longest path, until each node but the least of its component has one link, to that one; this is only counted, so
    no round is made to see that nothing moves.
    """
    tables: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        tables.append(work.write(df, name))
        return tables[-1]

    def star(edges: DataFrame, only_larger: bool) -> DataFrame:
        """edges (u, v). Each v (above u, if only_larger) is tied to the least of u and its neighbours."""
        least = kept(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        joined = edges.join(least, "u")
        tied = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if only_larger else joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not only_larger:
            tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
        return tied.where("u <> v").distinct()

    def ready(edges: DataFrame) -> bool:
        """Whether no node is tied to two, or tied and tied to: then each link is of a node and its component."""
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("tied")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("tied")))
        several = (F.sum("tied") > 1) | (F.sum("tied") > 0) & (F.min("tied") == 0)
        return ends.groupBy("id").agg(several.alias("several")).agg(F.count_if("several")).first()[0] == 0

    edges = kept(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not ready(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(star(both, True), "large")
        edges = kept(star(large, False), "edges")
        for old in tables[:-1]:
            work.drop(old)
        del tables[:-1]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
