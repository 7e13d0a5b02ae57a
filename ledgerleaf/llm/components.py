"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """u, root for every node of ``edges`` (u, v): root is the smallest node of u's component.

    Alternating stars: first every node's larger neighbours are hung on its smallest neighbour, then
    its smaller ones; the links shrink to a star a component in a number of rounds that grows with the
    logarithm of its size. Minima are pre-aggregated before the shuffle; joins on a hub are plain equi-joins,
    which adaptive execution splits. Each round is checkpointed, so lineage stays short and a lost
    executor costs one round. Stops when a round changes nothing.
    """
    now = reliable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        # large star: (u, v) both ways; larger neighbours of u go to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v")))
        now = reliable(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
