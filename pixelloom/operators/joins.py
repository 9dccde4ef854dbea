"""Joins of image data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.vector import euclidean

#: Offsets of a 3x3 neighbourhood in a fixed order: centre, NW, N, NE, W, E, SW, S, SE.
AROUND = [(0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
#: Most rows of a table of centroids that is sent to all executors.
MAX_CENTROIDS = 100_000


def pair(cover: DataFrame, stego: DataFrame, key: str = "image_id") -> DataFrame:
    """Cover and stego rows of the same key."""
    return cover.join(stego, key)


def with_costs(images: DataFrame, costs: DataFrame, suffix: str = ".mat") -> DataFrame:
    """Images with the cost map named after them."""
    return images.withColumn("_file", F.concat(F.col("name").cast("string"), F.lit(suffix))).join(costs.withColumnRenamed("file", "_file"), "_file").drop("_file")


def at_positions(rows: DataFrame, positions: DataFrame, repeat: bool = False, on: tuple[str, ...] = ("image_id", "i", "j")) -> DataFrame:
    """Rows at listed positions: once each, or as often as they are listed."""
    return rows.join(positions.select(*on), list(on), "inner" if repeat else "left_semi")


def with_coarse(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Each fine pixel with the coarse one that covers it; coarse columns other than the keys come along."""
    keyed = fine.withColumns({"_ci": F.expr(f"i div {factor}"), "_cj": F.expr(f"j div {factor}")})
    return keyed.join(coarse.withColumnsRenamed({"i": "_ci", "j": "_cj"}), ["image_id", "_ci", "_cj"]).drop("_ci", "_cj")


def reflected(i, n: int):
    """Index reflected at the borders without repeating the edge."""
    return F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i)


def around_places(height: int, width: int) -> np.ndarray:
    """Per pixel, row by row, the places of its nine values in the fixed order, borders reflected."""
    i, j = np.divmod(np.arange(height * width), width)
    mirror = lambda k, n: np.where(k < 0, -k, np.where(k > n - 1, 2 * (n - 1) - k, k))
    return np.stack([mirror(i + a, height) * width + mirror(j + b, width) for a, b in AROUND], axis=1)


def surround_in_images(images: DataFrame, height: int, width: int, px: str = "px") -> DataFrame:
    """Rows (image_id, i, j, around) from whole images: one gather per batch, no shuffle. Null images, and those of another size, have none."""
    places = around_places(height, width)

    def run(batches):
        i, j = np.divmod(np.arange(height * width, dtype=np.int32), np.int32(width))
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, height * width)
            for at in range(0, len(x), 256):  # images at a time
                part = x[at : at + 256]
                n = len(part)
                ids = b.column(0).slice(at, n).take(pa.array(np.repeat(np.arange(n), height * width)))
                around = pa.ListArray.from_arrays(np.arange(0, n * places.size + 1, 9, dtype=np.int32), pa.array(part[:, places].ravel()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(i, n)), pa.array(np.tile(j, n)), around], names=["image_id", "i", "j", "around"])

    kind = dict(images.dtypes)["image_id"]
    whole = images.where(F.size(px) == height * width).select("image_id", F.col(px).cast("array<double>").alias("px"))
    return whole.mapInArrow(run, f"image_id {kind}, i int, j int, around array<double>")


def surround(pixels: DataFrame, height: int, width: int, value: str = "v") -> DataFrame:
    """The same where only pixel rows are at hand: the nine values around each pixel (column `around`, in the fixed order), borders reflected. One shuffle per image key:
    every pixel is sent to the pixels that see it, then collected."""
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in enumerate(AROUND)])).alias("o")
    want = pixels.select("image_id", "i", "j", at).select(
        "image_id", F.col("i").alias("ti"), F.col("j").alias("tj"), "o.n", reflected(F.col("i") + F.col("o.a"), height).alias("i"), reflected(F.col("j") + F.col("o.b"), width).alias("j")
    )
    got = want.join(pixels.select("image_id", "i", "j", value), ["image_id", "i", "j"])
    rows = F.sort_array(F.collect_list(F.struct("n", F.col(value).alias("v"))))
    return got.groupBy("image_id", F.col("ti").alias("i"), F.col("tj").alias("j")).agg(F.transform(rows, lambda s: s["v"]).alias("around"))


def without(rows: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't among the others'."""
    return rows.join(others.select(*on), on, "left_anti")


def _blocks_of(centroids: DataFrame, most: int) -> list[DataFrame]:
    """The table as one, or in blocks of at most so many rows."""
    n = centroids.count()
    if n <= most:
        return [centroids]
    from pixelloom.operators.ranks import ranked

    numbered = ranked(centroids, "centroid", out="_block").withColumn("_block", F.floor(F.col("_block") / most))
    return [numbered.where(F.col("_block") == k).drop("_block") for k in range(-(-n // most))]


def nearest_centroid(rows: DataFrame, centroids: DataFrame, f: str = "f", most: int = MAX_CENTROIDS) -> DataFrame:
    """Each row with its nearest centroid and the distance; the smaller id wins ties. centroids: (centroid, c). At most `most` of them travel
    to the rows at once; more come in blocks, one after the other, and a row keeps the least so far. Without centroids rows have none."""
    best = None
    for block in _blocks_of(centroids, most):
        table = block.agg(F.collect_list(F.struct("centroid", "c")).alias("_all"))
        scored = F.transform("_all", lambda s: F.struct(euclidean(F.col(f), s["c"]).alias("distance"), s["centroid"].alias("centroid")))
        rows = rows.crossJoin(F.broadcast(table)).withColumn("_new", F.array_min(scored)).drop("_all")
        rows = rows.withColumn("_best", F.col("_new") if best is None else F.least("_best", "_new")).drop("_new")
        best = True
    return rows.withColumns({"centroid": F.col("_best.centroid"), "distance": F.col("_best.distance")}).drop("_best")


def centroid_vote(rows: DataFrame, centroids: DataFrame, k: int, alpha: float = 1.0, f: str = "f", most: int = MAX_CENTROIDS) -> DataFrame:
    """Per row (id, class, share): exponential votes of its k nearest centroids. centroids: (centroid, class, c), in blocks as above."""
    near = rows.withColumn("near", F.expr("cast(array() as array<struct<d: double, centroid: bigint, cls: bigint>>)"))
    for block in _blocks_of(centroids, most):
        table = block.agg(F.collect_list(F.struct(F.col("centroid").cast("long").alias("centroid"), F.col("class").cast("long").alias("cls"), "c")).alias("_all"))
        scored = F.transform("_all", lambda s: F.struct(euclidean(F.col(f), s["c"]).alias("d"), s["centroid"].alias("centroid"), s["cls"].alias("cls")))
        near = near.crossJoin(F.broadcast(table)).withColumn("near", F.slice(F.sort_array(F.concat("near", scored)), 1, k)).drop("_all")
    votes = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.cls").alias("class"), F.exp(-F.col("n.d") * alpha).alias("w"))
    share = votes.groupBy("id", "class").agg(F.sum("w").alias("w"))
    return share.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("id"))).drop("w")


def place_predictions(locations: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """Predictions at the pixels they were made for, by the row id that both carry from the start."""
    return locations.join(predictions, key)
