"""Connected components by alternating large-star and small-star rounds.

Defined results: edges with a null end and from a node to itself count for nothing; repeated edges and both directions of one are the
same; no edges give no rows; columns other than u and v aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.checkpoints import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> (node, component): the least node reachable. Nodes without edges are left
    out. Every round writes its edges, at most as many as before; a node's edges are never
    gathered: minima come from partial aggregates and go back by joins that can be split. It ends when
    every node has one edge, to a node without, or is such a node."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, now = now, cut(small, "edges")
        discard(before)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("top")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("top")))
        if not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("top").alias("top")).where("up > 1 OR (up = 1 AND top = 1)").count():
            break
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._written_at = now._written_at
    return out
