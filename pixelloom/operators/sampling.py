"""Sampling and splitting. Random orders come from hashes of keys, so that they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, seed: int = 0, modulus: int = 1_000_003) -> Column:
    """A pseudo-random number of a whole-number key that any SQL engine computes alike."""
    return F.pmod(F.col(key) * 2_654_435_761 + seed * 40_503, F.lit(modulus))


def shuffled(rows: DataFrame, key: str, seed: int = 0, n: int | None = None) -> DataFrame:
    """Rows in a pseudo-random order, all or the first n."""
    out = rows.orderBy(hash_order(key, seed), key)
    return out if n is None else out.limit(n)


def match_rate(rows: DataFrame, key: str, by: str = "image_id", diff: str = "d", seed: int = 0) -> DataFrame:
    """All changed rows, and of each group's unchanged ones a share that about equals their number."""
    per = rows.groupBy(by).agg((F.sum((F.col(diff) != 0).cast("double")) / F.sum((F.col(diff) == 0).cast("double"))).alias("_rate"))
    u = hash_order(key, seed) / 1_000_003.0
    return rows.join(per, by).where((F.col(diff) != 0) | (u < F.col("_rate"))).drop("_rate")


def balanced(rows: DataFrame, n: int, key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """The first n rows of each class in a pseudo-random order. Ranks start inside hash shards, so that a class isn't sorted in
    one task: a shard's first n rows are all that can be among the class's first n."""
    order = [hash_order(key, seed), F.col(key)]
    shard = F.pmod(F.xxhash64(key), F.lit(64)).alias("_s")
    w = Window.partitionBy(label, "_s").orderBy(*order)
    near = rows.withColumn("_s", shard).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_s")


def indicators(rows: DataFrame, key: str, label: str = "label", by: str = "image_id", seed: int = 0) -> DataFrame:
    """1 for all positives and for as many pseudo-random negatives of each image, 0 for the others (column `take`)."""
    w = Window.partitionBy(by)
    ranked = rows.withColumns({"_p": F.sum((F.col(label) > 0).cast("long")).over(w), "_r": F.row_number().over(Window.partitionBy(by, F.col(label) > 0).orderBy(hash_order(key, seed), key))})
    return ranked.withColumn("take", ((F.col(label) > 0) | (F.col("_r") <= F.col("_p"))).cast("int")).drop("_p", "_r")


def split(rows: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) by the hash of a key: the same row always falls on the same side."""
    u = hash_order(key, seed) < test * 1_000_003
    return rows.where(~u), rows.where(u)


def stratified_folds(rows: DataFrame, key: str, k: int = 5, label: str = "label", seed: int = 0) -> DataFrame:
    """Folds 0 to k-1 of near-equal size within each class (column `fold`); the first ones are larger by one. A class is numbered over many
    tasks, however large it is."""
    from pixelloom.operators.ranks import ranked

    dealt = ranked(rows.withColumn("_h", hash_order(key, seed)), "_h", key, by=(label,), out="_r", size="_n")
    least, more = F.floor(F.col("_n") / k), F.col("_n") % k
    late = F.col("_r") >= more * (least + 1)
    fold = F.when(late, more + F.floor((F.col("_r") - more * (least + 1)) / F.greatest(least, F.lit(1)))).otherwise(F.floor(F.col("_r") / (least + 1)))
    return dealt.withColumn("fold", fold.cast("int")).drop("_h", "_r", "_n")


def between(rows: DataFrame, low: int, high: int, order: str) -> DataFrame:
    """Rows low to high - 1 of an order. Only the order's column is dealt; the rows are filtered by its two ends."""
    from pixelloom.operators.ranks import ranked

    ends = ranked(rows.select(order), order, out="_r").where(F.col("_r").between(low, high - 1)).agg(F.min(order), F.max(order)).first()
    return rows.where(F.col(order).between(F.lit(ends[0]), F.lit(ends[1])))

