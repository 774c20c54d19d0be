"""Connected components as DataFrame rounds: no edge or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component: the smallest node reachable) for every node with an edge.

    Large-star and small-star rounds: each node's neighbours are hung below its smallest neighbour until only stars are left.
    Hot nodes cost no more than their edges: minima are aggregated before the shuffle. Each round is written to the shared folder.
    """
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e, before = written(small), e
        discard(edges.sparkSession, before)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct()).groupBy("node").agg(F.min("component").alias("component"))
