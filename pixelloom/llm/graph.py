"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import drop_scratch, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the smallest node reachable.

    Each step aggregates with partial minima and joins the minimum back, so a node with very many edges is
    never gathered in one task (adaptive execution splits the join). Node ids are longs. No edges give no rows; an edge with a null end
    joins nothing and is left out, and so is an edge from a node to itself.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v").distinct()
        new = materialize(small, "edges")
        drop_scratch(now)
        now = new
        # done when every node points to one other, and that to none
        sides = now.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        open_ = sides.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
        if not open_.limit(1).count():
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
