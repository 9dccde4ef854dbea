"""Image operators, one image per row (image_id, h, w, c, px), and their row forms where joins express them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.operators.windows import per_image


def sobel(images: DataFrame, blur: float | None = None) -> DataFrame:
    return per_image(images, lambda x: grid.sobel(x[:, :, 0], blur))


def roberts(images: DataFrame, in_place: bool = True) -> DataFrame:
    return per_image(images, lambda x: grid.roberts(x[:, :, 0], in_place))


def residual_maps(images: DataFrame) -> DataFrame:
    return per_image(images, lambda x: grid.residual_maps(x[:, :, 0]))


def gaussian(images: DataFrame, sigma: float = 1.0) -> DataFrame:
    return per_image(images, lambda x: grid.gaussian(x[:, :, 0], sigma))


def dilate(images: DataFrame, k: int = 3) -> DataFrame:
    return per_image(images, lambda x: grid.dilate(x[:, :, 0], k))


def dilate_pixels(pixels: DataFrame, height: int, width: int, k: int = 3, value: str = "v") -> DataFrame:
    """Row form: every pixel offers its value to the pixels that see it, and the largest wins."""
    lo, hi = -(k // 2), k - 1 - k // 2
    seen = F.explode(F.expr(f"flatten(transform(sequence({-hi}, {-lo}), a -> transform(sequence({-hi}, {-lo}), b -> struct(i + a as i, j + b as j))))")).alias("p")
    rows = pixels.select("image_id", F.col(value).alias("v"), seen).select("image_id", "p.i", "p.j", "v")
    return rows.where(f"i between 0 and {height - 1} and j between 0 and {width - 1}").groupBy("image_id", "i", "j").agg(F.max("v").alias(value))


def canny(images: DataFrame, low: float, high: float, sigma: float = 1.0) -> DataFrame:
    return per_image(images, lambda x: grid.canny(x[:, :, 0], low, high, sigma))


def thin_edges(images: DataFrame) -> DataFrame:
    """Non-maximum suppression along the gradient's direction."""

    def run(x):
        gy, gx = np.gradient(x[:, :, 0])
        return grid.suppress_nonmaxima(np.hypot(gx, gy), np.arctan2(gy, gx))

    return per_image(images, run)


def resize(images: DataFrame, h: int, w: int, how: str = "nearest") -> DataFrame:
    return per_image(images, lambda x: grid.resize(x, h, w, how))


def turn_pixels(pixels: DataFrame, height: int, width: int, how: str = "rotate") -> DataFrame:
    """Row form of augmentation: a quarter turn clockwise, or a left-right flip."""
    if how == "flip":
        return pixels.withColumn("j", width - 1 - F.col("j"))
    return pixels.withColumns({"i": F.col("j"), "j": height - 1 - F.col("i")})


def bordered(images: DataFrame, r: int, border: str = "symmetric") -> DataFrame:
    return per_image(images, lambda x: grid.pad(x, r, border))


def wavelet_cost(images: DataFrame) -> DataFrame:
    return per_image(images, lambda x: grid.wavelet_cost(x[:, :, 0]))


def orientation_descriptors(images: DataFrame, size: int = 32) -> DataFrame:
    """(image_id, bi, bj, f): 128 numbers from each block alone. dense_sift() has the full descriptor."""
    cut = lambda x: np.stack([grid.orientation_descriptor(x[i : i + size, j : j + size]) for i in range(0, x.shape[0] - size + 1, size) for j in range(0, x.shape[1] - size + 1, size)])
    return _descriptors(images, lambda x: cut(x).reshape(x.shape[0] // size, x.shape[1] // size, -1) if min(x.shape) >= size else np.zeros((0, 0, 128)))


def dense_sift(images: DataFrame, size: int = 32, cell: float | None = None) -> DataFrame:
    """(image_id, bi, bj, f): the SIFT descriptor around the middle of every block; see grid.sift."""
    return _descriptors(images, lambda x: grid.sift(x, size, cell))


def _descriptors(images: DataFrame, fn) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = []
            for k, h, w, px in zip(b["image_id"], b["h"], b["w"], b["px"]):
                made = fn(np.asarray(px, float).reshape(h, w))
                rows += [(k, i, j, made[i, j]) for i in range(made.shape[0]) for j in range(made.shape[1])]
            yield pd.DataFrame(rows, columns=["image_id", "bi", "bj", "f"])

    return images.where("px is not null").select("image_id", "h", "w", "px").mapInPandas(run, "image_id long, bi long, bj long, f array<double>")


def splice_samples(images: DataFrame, truth: str = "gt", edges: str = "edge", boundary: int = 5, far: int = 10) -> DataFrame:
    """Targets per pixel: +1 on edges near the border of the spliced part, -1 on edges far from it, 0 elsewhere."""

    def run(batches):
        for b in batches:
            made = []
            for h, w, t, e in zip(b["h"], b["w"], b[truth], b[edges]):
                border = (grid.roberts(np.asarray(t, float).reshape(h, w), in_place=False) > 0).astype(float)
                edge = np.asarray(e, float).reshape(h, w) > 0
                near, around = grid.dilate(border, boundary) > 0, grid.dilate(border, far) > 0
                made.append(np.where(edge & near, 1.0, np.where(edge & ~around, -1.0, 0.0)).ravel())
            yield pd.DataFrame({"image_id": b["image_id"], "h": b["h"], "w": b["w"], "c": 1, "px": made})

    return images.select("image_id", "h", "w", truth, edges).mapInPandas(run, "image_id long, h int, w int, c int, px array<double>")


def fuse_maps(*maps: Column, legacy: bool = False) -> Column:
    """Largest of the maps and 0. legacy: only the first two count, as where the third was an output buffer."""
    used = maps[:2] if legacy else maps
    return F.greatest(*used, F.lit(0.0))


def synthetic_shapes(spark, size: int = 32, tile: int = 8) -> DataFrame:
    """Large shapes and the same ones tiled small, as images."""
    rows = []
    for n, kind in enumerate(("circle", "square", "cross")):
        for t in (None, tile):
            rows.append((2 * n + (t is not None), size, size, 1, grid.shapes(size, kind, t).ravel().tolist()))
    return spark.createDataFrame(rows, "image_id long, h int, w int, c int, px array<double>")
