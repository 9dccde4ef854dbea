"""Set operations on rows and index lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def leaf_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members (leaf, image_id, i, j) that left or entered a leaf between two trees: column side is `left` or `entered`."""
    on = ["leaf", "image_id", "i", "j"]
    gone = a.join(b, on, "left_anti").withColumn("side", F.lit("left"))
    come = b.join(a, on, "left_anti").withColumn("side", F.lit("entered"))
    return gone.unionByName(come)


def covered(total: int, *tables: DataFrame) -> DataFrame:
    """Distinct keys of all tables, and whether they are all there are."""
    return stack(*tables).distinct().agg(F.count("*").alias("n"), (F.count("*") == total).alias("complete"))


def both(a: Column, b: Column) -> Column:
    return (a.cast("boolean") & b.cast("boolean")).cast("int")


def leaf_channels(every: Column, passed: Column) -> Column:
    """Channels that no later hop takes up."""
    return F.array_except(every, passed)


def delete_rows(rows: DataFrame, keys: DataFrame, on: str = "sample_id") -> DataFrame:
    return rows.join(keys, on, "left_anti")
