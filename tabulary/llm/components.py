"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulary.session import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable from each node that has a link.

    Alternating large and small stars: every node's larger neighbours, then its smaller ones,
    are linked to the smallest neighbour, until only stars are left. Minima are combined before
    the shuffle, and hubs reach the joins as ordinary keys that adaptive execution may split.
    Each round is a written table, so a lost executor costs no earlier round.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    edges = links.filter(F.col(a) != F.col(b)).select(high.alias("u"), low.alias("v")).distinct()
    edges = written(edges, "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = written(
            small.filter("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct(),
            "links",
        )
        # The same set of links twice: nothing moves any more.
        now = edges.agg(
            F.count(F.lit(1)),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if now == state:
            break
        state = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select("component", "component").distinct().toDF("node", "component"))
