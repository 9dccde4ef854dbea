"""Neighbourhood operators. Array form: one image per row, windows cut by numpy inside Arrow batches. Row form: joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions import grid

FEATURES = "image_id long, i long, j long, f array<double>"
PLANES = ["image_id", "h", "w", "c", "px"]
#: Numbers that a task makes before it hands them on (8 MB), so that its memory doesn't grow with the batch times the channels.
HELD = 1 << 20


def per_image(images: DataFrame, fn: Callable[[np.ndarray], np.ndarray], array: str = "px") -> DataFrame:
    """Apply fn (h x w x c -> h' x w' x k) to every image: rows (image_id, h, w, c, px), handed on in parts of bounded size."""

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for k, px, h, w, c in zip(b["image_id"], b[array], b["h"], b["w"], b["c"]):
                m = np.asarray(fn(grid.as_image(px, h, w, c)), float)
                m = m if m.ndim == 3 else m[:, :, None]
                rows.append((k, *m.shape, m.ravel()))
                held += m.size
                if held >= HELD:
                    yield pd.DataFrame(rows, columns=PLANES)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=PLANES)

    return images.select("image_id", "h", "w", "c", array).mapInPandas(run, "image_id long, h int, w int, c int, px array<double>")


def features_of(images: DataFrame) -> DataFrame:
    """One row per pixel with its channels: (image_id, i, j, f)."""
    rows = images.select("image_id", F.col("w").cast("long").alias("w"), F.expr("transform(sequence(0, h * w - 1), p -> slice(px, p * c + 1, c))").alias("_f"))
    rows = rows.select("image_id", "w", F.posexplode("_f").alias("pos", "f"))
    return rows.select("image_id", F.expr("pos div w").alias("i"), F.expr("pos % w").alias("j"), "f")


def gather(images: DataFrame, size: int = 5, border: str | None = "symmetric", pool_first: str | None = None, stride: int = 1, pool_after: str | None = None) -> DataFrame:
    """Neighbourhood features of each pixel as an image with more channels."""
    return per_image(images, lambda x: grid.gather(x, size, border, pool_first, stride, pool_after))


def ungather(images: DataFrame, size: int) -> DataFrame:
    return per_image(images, lambda x: grid.ungather(x, size))


def neighbours(images: DataFrame, reach: int = 1, dilate: int = 1, border: str = "reflect", centre_last: bool = True) -> DataFrame:
    return per_image(images, lambda x: grid.neighbours(x, reach, dilate, border, centre_last))


def patches(images: DataFrame, size: int, stride: int = 1, border: str | None = None) -> DataFrame:
    """All size x size patches, optionally after padding."""
    return per_image(images, lambda x: grid.gather(x, size, border, None, stride))


def dilated_points(images: DataFrame, spacing: int, points: int = 3) -> DataFrame:
    """points x points samples `spacing` apart around each pixel, edges repeated."""
    reach = points // 2
    return per_image(images, lambda x: grid.neighbours(x, reach, spacing, "symmetric", centre_last=False))


def aggregate_neighbours(images: DataFrame, size: int = 3, modes: tuple[int, ...] = (1, 2, 3), border: str = "reflect") -> DataFrame:
    return per_image(images, lambda x: grid.aggregate_neighbours(x, size, modes, border))


def blocks(pixels: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Blocks that don't overlap: (image_id, bi, bj, f) with f in raster order."""
    rows = F.sort_array(F.collect_list(F.struct("i", "j", F.col(value).alias("v"))))
    return pixels.groupBy("image_id", F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj")).agg(F.transform(rows, lambda s: s["v"]).alias("f"))


def centred_patches(images: DataFrame, centres: DataFrame, size: int) -> DataFrame:
    """Patches around listed pixels (image_id, i, j) that lie wholly inside: features rows."""
    asked = centres.groupBy("image_id").agg(F.collect_list(F.struct("i", "j")).alias("at"))

    def cut(batches):
        r = size // 2
        for b in batches:
            rows = []
            for k, h, w, c, px, at in zip(b["image_id"], b["h"], b["w"], b["c"], b["px"], b["at"]):
                x = grid.as_image(px, h, w, c)
                for p in at:
                    i, j = p["i"], p["j"]
                    if r <= i < h - r and r <= j < w - r:
                        rows.append((k, i, j, x[i - r : i + r + 1, j - r : j + r + 1].ravel()))
            yield pd.DataFrame(rows, columns=["image_id", "i", "j", "f"])

    return images.join(asked, "image_id").select("image_id", "h", "w", "c", "px", "at").mapInPandas(cut, FEATURES)


def tiles(pixels: DataFrame, first: int = 2, step: int = 64, size: int = 60, per_side: int = 4) -> DataFrame:
    """Pixels inside a grid of tiles, with the tile number and the position in it; gaps between tiles are dropped."""
    for a, t in (("i", "ti"), ("j", "tj")):
        pixels = pixels.where(f"{a} >= {first} AND ({a} - {first}) % {step} < {size} AND ({a} - {first}) div {step} < {per_side}").withColumn(t, F.expr(f"({a} - {first}) div {step}"))
    return pixels.withColumns({"tile": F.expr(f"ti * {per_side} + tj"), "i": F.expr(f"(i - {first}) % {step}"), "j": F.expr(f"(j - {first}) % {step}")}).drop("ti", "tj")


def thin(images: DataFrame, reach: int = 10, array: str = "px") -> DataFrame:
    """Greedy thinning of change maps in raster order."""
    return per_image(images, lambda x: grid.thin(x[:, :, 0], reach), array)


def hard_ring(images: DataFrame, reach: int = 1, array: str = "px") -> DataFrame:
    """Unchanged pixels next to changed ones."""
    return per_image(images, lambda x: grid.ring(x[:, :, 0], reach), array)


def running_energy(energies: DataFrame, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return energies.withColumn("running", F.sum("energy").over(w))


def zigzag(n: int) -> list[tuple[int, int, int]]:
    """(i, j, rank) of an n x n block, walked along its anti-diagonals to and fro."""
    order = sorted(((i, j) for i in range(n) for j in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [(i, j, r) for r, (i, j) in enumerate(order)]


def zigzag_groups(pixels: DataFrame, n: int) -> DataFrame:
    """Each pixel with the rank of its place in an n x n zig-zag tiled over the image (column `group`)."""
    table = pixels.sparkSession.createDataFrame(zigzag(n), "_i long, _j long, group long")
    return pixels.withColumns({"_i": F.col("i") % n, "_j": F.col("j") % n}).join(F.broadcast(table), ["_i", "_j"]).drop("_i", "_j")


def lattice(pixels: DataFrame, height: int, width: int, depth: int = 0, n: int = 4, value: str = "v") -> DataFrame:
    """n x n cells of an image's upper left part, 4^depth times smaller than the image: (image_id, bi, bj, f). Cells that the part cuts off are
    left out."""
    h, w = height // 4**depth // n * n, width // 4**depth // n * n
    return blocks(pixels.where((F.col("i") < h) & (F.col("j") < w)), n, value)


def subsample(pixels: DataFrame) -> DataFrame:
    """Every other row and column, the upper left of each 2 x 2 block."""
    return pixels.where("i % 2 = 0 AND j % 2 = 0").withColumns({"i": F.expr("i div 2"), "j": F.expr("j div 2")})
