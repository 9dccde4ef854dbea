"""Global orders without a single task: rows are dealt by range, numbered by their task, and shifted by the counts of the tasks before.

The order's columns have to tell rows apart as far as the result should; rows equal in all of them are numbered in any order. A group of
any size spreads over tasks, as long as its rows differ in the order. Nulls come first. An empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.sources.scratch import written

#: Most rows of (task, group) counts that are broadcast; more are joined by shuffle.
SMALL = 1_000_000


def dealt(rows: DataFrame, *order) -> DataFrame:
    """Written rows in their order: `_place` rises with it, `_part` is the task that holds a contiguous run."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    return written(ranged.withColumn("_place", F.monotonically_increasing_id()), "dealt").withColumn("_part", F.shiftright("_place", 33))


def _join(rows: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    same = None
    for c in on:
        one = rows[c].eqNullSafe(small[c])
        same = one if same is None else same & one
    small = F.broadcast(small) if small.limit(SMALL + 1).count() <= SMALL else small
    return rows.join(small, same).drop(*[small[c] for c in on])


def ranked(rows: DataFrame, *order, by: tuple[str, ...] = (), out: str = "rank", size: str | None = None) -> DataFrame:
    """rows with their number from 0 within their group, in the order; size: a column with the number of the group's rows."""
    placed = dealt(rows, *by, *order)
    per = placed.groupBy("_part", *by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row per task and group
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = per.select("_part", *by, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_size"))
    out_rows = _join(placed, shifts, ["_part", *by]).withColumn(out, F.col("_place") + F.col("_shift"))
    return (out_rows.withColumn(size, F.col("_size")) if size else out_rows).drop("_place", "_part", "_shift", "_size")


def running_before(rows: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """rows with the sum of value over all rows before them; order tells rows apart."""
    placed = dealt(rows, order)
    whole = placed.groupBy("_part").agg(F.sum(value).alias("_sum"))
    shifts = whole.select("_part", F.coalesce(F.sum("_sum").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _join(placed.withColumn("_own", own), shifts, ["_part"]).withColumn(out, F.col("_own") + F.col("_shift")).drop("_own", "_shift", "_part", "_place")
