"""Connected components of a graph that is given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import Stage, few_parts


def components(edges: DataFrame, stage: Stage, name: str) -> DataFrame:
    """``node`` and the smallest node it is connected with, ``component``, for the nodes of ``edges`` (``a``, ``b``: long).

    In a large star every larger neighbour of a node is linked to the smallest neighbour, in a small
    star every smaller one; both keep what is connected. The links become stars around the smallest
    node of each component after about as many rounds as the logarithm of the longest chain.
    Each round shuffles the links three times and is written to the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    links = edges.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, before, turn = stage.write(few_parts(links), f"{name}0"), None, 0
    while True:
        found = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == before:
            return links.select(a.alias("node"), b.alias("component")).unionByName(
                links.select(b.alias("node"), b.alias("component")).distinct()
            )
        before = found
        # Dealt out by node once, for the minimum and for its join.
        both = links.unionByName(links.select(b.alias("a"), a.alias("b"))).repartition("a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("least").alias("b")).filter(a != b).repartition("a")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(b.alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        turn += 1
        links = stage.write(few_parts(small.filter(a != b).distinct()), f"{name}{turn}")
        stage.drop(f"{name}{turn - 1}")
