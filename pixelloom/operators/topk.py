"""Sorts, limits and selections of extremes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.functions.vector import euclidean


def lowest_cost(pixels: DataFrame, n: int, cost: str = "rho") -> DataFrame:
    """The region of interest: the n pixels of least cost of each image, ties by position. One shuffle, on the image."""
    w = Window.partitionBy("image_id").orderBy(cost, "i", "j")
    return pixels.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def lowest_cost_in_images(images: DataFrame, n: int, costs: str = "costs") -> DataFrame:
    """The same from whole images with an array of (cost, i, j, ...): `roi` has the n least, ties by position; no shuffle."""
    return images.withColumn("roi", F.slice(F.array_sort(costs), 1, n))


def region_sweep(pixels: DataFrame, sizes: list[int], cost: str = "rho", diff: str = "d") -> DataFrame:
    """Per image and region size precision and recall of the region against the changes."""
    w = Window.partitionBy("image_id").orderBy(cost, "i", "j")
    ranked = pixels.select("image_id", F.row_number().over(w).alias("rank"), F.sum((F.col(diff) != 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("hits"), F.sum((F.col(diff) != 0).cast("long")).over(Window.partitionBy("image_id")).alias("all"))
    return ranked.where(F.col("rank").isin(sizes)).select("image_id", F.col("rank").cast("long").alias("n"), (F.col("hits") / F.col("rank")).alias("precision"), (F.col("hits") / F.col("all")).alias("recall"))


def region_sweep_in_images(images: DataFrame, sizes: list[int], costs: str = "costs") -> DataFrame:
    """The same from whole images with an array of (cost, i, j, change): the array is sorted, its changes counted; no shuffle. Sizes beyond an
    image's pixels have no row."""
    hits = F.aggregate(F.slice(F.col("_sorted"), 1, F.col("n").cast("int")), F.lit(0), lambda t, s: t + (s["d"] != 0).cast("int"))
    every = F.aggregate("_sorted", F.lit(0), lambda t, s: t + (s["d"] != 0).cast("int"))
    rows = images.select("image_id", F.array_sort(costs).alias("_sorted")).select("image_id", "_sorted", F.explode(F.array(*[F.lit(n).cast("long") for n in sizes])).alias("n")).where(F.col("n") <= F.size("_sorted"))
    return rows.select("image_id", "n", (hits / F.col("n")).alias("precision"), (hits / every).alias("recall"))


def by_number_in_name(names: DataFrame, column: str = "name", suffix: int = 4) -> DataFrame:
    """File names in the order of the number before the suffix of so many characters."""
    number = F.expr(f"cast(left({column}, length({column}) - {suffix}) as bigint)")
    return names.withColumn("number", number).orderBy("number")


def eigen_order(energies: DataFrame, n: int | None = None) -> DataFrame:
    rows = energies.orderBy(F.desc("energy"), "k")
    return rows if n is None else rows.limit(n)


def best_features(scores: DataFrame, n: int = 27, score: str = "ce") -> DataFrame:
    return scores.orderBy(score, "feature").limit(n)


def farthest(rows: DataFrame, target: list[float], n: int, f: str = "f", key: str = "id") -> DataFrame:
    """The n rows farthest from a point."""
    point = F.array(*[F.lit(float(x)) for x in target])
    return rows.withColumn("distance", euclidean(F.col(f), point)).orderBy(F.desc("distance"), key).limit(n)


def separated_extremes(images: DataFrame, count: int, reach: int, largest: bool = True) -> DataFrame:
    """Extreme pixels one after the other, each clearing its neighbourhood: (image_id, pick, i, j)."""

    def run(batches):
        for b in batches:
            rows = [(k, n, i, j) for k, h, w, px in zip(b["image_id"], b["h"], b["w"], b["px"]) for n, (i, j) in enumerate(grid.picks(np.asarray(px, float).reshape(h, w), count, reach, largest))]
            yield pd.DataFrame(rows, columns=["image_id", "pick", "i", "j"])

    return images.select("image_id", "h", "w", "px").mapInPandas(run, "image_id long, pick long, i long, j long")


def first_n(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def restored(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """The order that samples had before they were dealt out."""
    return rows.orderBy(key)
