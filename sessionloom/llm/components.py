"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node it reaches.

    Null ends and loops are ignored, repeated edges count once, no edge gives no row. Each round is written to the
    shared folder; only whether stars remain to be made reaches the driver. Minima are pre-aggregated, and written before they are
    joined back, so that the join on a node of very high degree shuffles both sides and can be split as skewed.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v")
    now = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = now.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("w"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        # Stars around the smallest node: no node has two edges to smaller ones, or edges both ways.
        if not nodes.agg(F.coalesce(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))), F.lit(False))).first()[0]:
            roots = nodes.where("up = 0").select(F.col("w").alias("node"), F.col("w").alias("component"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")))
        large = both.join(low, both.u == low.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        low = cut(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(low, large.u == low.w).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
