"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut_at, delete


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node that an edge names; ``component`` is the smallest node it reaches.

    Each round links every node's larger neighbours to the smallest node near it, then every node's smaller
    neighbours likewise, which takes a number of rounds that grows with the logarithm of the longest path. Both
    steps aggregate minima before they join, so that a node with very many neighbours is no single group.
    Edges with a null end and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut_at(now, "edges")
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt, at = cut_at(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # a forest of stars: every node has one edge, and no target has an edge of its own
        open_ = nxt.groupBy("u").count().where("count > 1").limit(1).count() or nxt.join(nxt.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count()
        delete(spark, path)
        now, path = nxt, at
        if not open_:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
