"""Predicates and filters over pixels, channels and blocks. Pixels are rows (image_id, i, j, ...)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.functions.vector import std


def changed(pixels: DataFrame, diff: str = "d", keep: bool = True) -> DataFrame:
    """Pixels that the payload changed, or the others."""
    return pixels.where(F.col(diff) != 0) if keep else pixels.where(F.col(diff) == 0)


def energetic_channels(features: DataFrame, energies: list[float], threshold: float, f: str = "f") -> DataFrame:
    """Only the channels whose energy reaches the threshold."""
    keep = [k for k, e in enumerate(energies) if e >= threshold]
    return features.withColumn(f, F.transform(F.array(*[F.lit(k) for k in keep]), lambda k: F.get(F.col(f), k)))


def cumulative_energy_cut(energies: DataFrame, threshold: float, *by: str) -> DataFrame:
    """The first channels whose running energy passes the threshold, that one included."""
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return energies.withColumn("before", F.coalesce(F.sum("energy").over(w), F.lit(0.0))).where(F.col("before") <= threshold).drop("before")


def informative_channels(features: DataFrame, information: DataFrame) -> DataFrame:
    """Rows (.., ch, v) of channels whose mutual information isn't 0."""
    return features.join(information.where("mi <> 0").select("ch"), "ch", "left_semi")


def strong_targets(rows: DataFrame, y: str = "y", least: float = 0.05) -> DataFrame:
    return rows.where(F.abs(y) >= least)


def varied_patches(rows: DataFrame, f: str = "f", least: float = 1e-5) -> DataFrame:
    """Patches that aren't constant."""
    return rows.where(std(F.col(f)) >= least)


def busy_blocks(pixels: DataFrame, size: int = 32, share: int = 64, diff: str = "d") -> DataFrame:
    """Blocks that hold more than 1/share of their image's changes: (image_id, bi, bj, n)."""
    cells = pixels.groupBy("image_id", F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj"))
    cells = cells.agg(F.sum((F.col(diff) != 0).cast("long")).alias("n"))
    return cells.withColumn("total", F.sum("n").over(Window.partitionBy("image_id"))).where(F.col("n") > F.col("total") / share).drop("total")


def changed_windows(images: DataFrame, size: int = 32, share: float = 0.2) -> DataFrame:
    """Corners (image_id, i, j) of windows with much change; order matters, so each image is scanned alone.
    images: (image_id, h, w, diff)."""

    def scan(batches):
        for b in batches:
            rows = [(k, i, j) for k, h, w, d in zip(b["image_id"], b["h"], b["w"], b["diff"]) for i, j in grid.dense_windows(np.asarray(d).reshape(h, w), size, share)]
            yield pd.DataFrame(rows, columns=["image_id", "i", "j"])

    return images.select("image_id", "h", "w", "diff").mapInPandas(scan, "image_id long, i long, j long")


def hysteresis(pixels: DataFrame, low: float, high: float, value: str = "v") -> DataFrame:
    """1 from high on, -1 below low; between them 1 next to a strong pixel of the input, else -1 (column `mark`)."""
    strong = pixels.where(F.col(value) >= high).select("image_id", "i", "j")
    near = strong.select(
        "image_id", F.explode(F.expr("flatten(transform(sequence(-1, 1), a -> transform(sequence(-1, 1), b -> struct(i + a as i, j + b as j))))")).alias("p")
    ).select("image_id", "p.i", "p.j").distinct().withColumn("near", F.lit(True))
    mark = F.when((F.col(value) >= high) | ((F.col(value) >= low) & F.coalesce("near", F.lit(False))), 1).otherwise(-1)
    return pixels.join(near, ["image_id", "i", "j"], "left").withColumn("mark", mark).drop("near")


def binarize(pixels: DataFrame, threshold: float, value: str = "v") -> DataFrame:
    return pixels.withColumn(value, F.when(F.col(value) > threshold, 1).otherwise(0))


def boundary_targets(pixels: DataFrame) -> DataFrame:
    """+1 where boundary and edge meet, -1 on authentic edges, 0 elsewhere (column `target`)."""
    return pixels.withColumn("target", F.when((F.col("boundary") != 0) & (F.col("edge") != 0), 1).when(F.col("authentic") != 0, -1).otherwise(0))


def balance_negatives(rows: DataFrame, order: str, label: str = "label", positive: int = 1) -> DataFrame:
    """All positives and, per image, as many negatives, in a given visiting order."""
    w = Window.partitionBy("image_id")
    counted = rows.withColumn("_p", F.sum((F.col(label) == positive).cast("long")).over(w))
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy("image_id", (F.col(label) == positive)).orderBy(order)))
    return ranked.where((F.col(label) == positive) | (F.col("_r") <= F.col("_p"))).drop("_p", "_r")


def background(rows: DataFrame, y: str = "y", width: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Rows inside the open band around 0, and the others."""
    inside = (F.col(y) > -width) & (F.col(y) < width)
    return rows.where(inside), rows.where(~inside)
