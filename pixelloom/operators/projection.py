"""Projections and reshapes: between images (one row each, `px`) and pixels (image_id, i, j, v), and over channel arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_pixels(images: DataFrame, array: str = "px", width: str | int = "w", value: str = "v", *keep: str) -> DataFrame:
    """One row per pixel of a one-channel image: image_id, kept columns, pos, i, j, value."""
    w = F.col(width) if isinstance(width, str) else F.lit(width)
    rows = images.select("image_id", *keep, w.cast("long").alias("_w"), F.posexplode(array).alias("pos", value))
    return rows.select("image_id", *keep, F.col("pos").cast("long").alias("pos"), F.expr("pos div _w").alias("i"), (F.col("pos") % F.col("_w")).alias("j"), value)


def collect_pixels(pixels: DataFrame, value: str = "v", key: str = "image_id") -> DataFrame:
    """Back to one raster-ordered array per image."""
    rows = F.sort_array(F.collect_list(F.struct("i", "j", F.col(value).alias("v"))))
    return pixels.groupBy(key).agg(F.transform(rows, lambda s: s["v"]).alias("px"))


def gather_channels(f: Column, ids: list[int]) -> Column:
    """The channels of a list, in its order."""
    return F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.get(f, i))


def channel_slice(f: Column, low: int, high: int) -> Column:
    """Channels low to high - 1."""
    return F.slice(f, low + 1, high - low)


def drop_dc(f: Column) -> Column:
    return F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0)))


def concat_channels(*features: Column) -> Column:
    return F.concat(*features)


def concat_hops(hops: list[DataFrame], concat=None) -> DataFrame:
    """Join the hops' features on the pixel and let a callback make one column of them; by default they stay as they are."""
    out = hops[0].withColumnRenamed("f", "f0")
    for n, h in enumerate(hops[1:], 1):
        out = out.join(h.withColumnRenamed("f", f"f{n}"), ["image_id", "i", "j"])
    return concat(out) if concat else out


def scale(f: Column, divisor: float = 255.0) -> Column:
    return F.transform(f, lambda x: x / divisor)


def with_label(rows: DataFrame, label: float) -> DataFrame:
    return rows.withColumn("label", F.lit(float(label)))


def kernels_by_layer(params: DataFrame) -> DataFrame:
    """The kernels of a parameter table in the order of layers and units."""
    return params.select("layer", "unit", "k", "kernel").orderBy("layer", "unit", "k")


def survived_offsets(energies: DataFrame, threshold: float, block: int = 25) -> DataFrame:
    """Running offsets of kept channels (layer, block, kept, offset). Whole blocks of `block` channels count; those without a
    kept channel are left out; offsets go on from layer to layer."""
    full = energies.withColumns({"block": F.expr(f"cast(k div {block} as bigint)"), "n": F.count("*").over(Window.partitionBy("layer"))})
    full = full.where(F.col("block") < F.expr(f"n div {block}"))
    kept = full.groupBy("layer", "block").agg(F.sum((F.col("energy") >= threshold).cast("long")).alias("kept")).where("kept > 0")
    order = Window.orderBy("layer", "block").rowsBetween(Window.unboundedPreceding, 0)  # a row per 25 channels of one model
    return kept.withColumn("offset", F.sum("kept").over(order))


def coarse_index(i: Column, hop: int, factor: int | None = None) -> Column:
    """Index of a pixel in a coarser hop; the factor is 2^hop - 1 unless it is given."""
    f = 2**hop - 1 if factor is None else factor
    return F.floor(i / F.lit(f)).cast("long")


def split_pass_stay(f: Column, passed: int = 3) -> tuple[Column, Column]:
    """The first channels go on to the next hop, the rest stay."""
    return F.slice(f, 1, passed), F.slice(f, F.lit(passed + 1), F.greatest(F.size(f) - passed, F.lit(0)))


def append_bias(f: Column, last: bool = True) -> Column:
    one = F.array(F.lit(1.0))
    return F.concat(f, one) if last else F.concat(one, f)


def mask_low_energy(f: Column, energy: Column, threshold: float) -> Column:
    """Channels whose energy reaches the threshold."""
    return F.transform(F.filter(F.arrays_zip(f.alias("x"), energy.alias("e")), lambda s: s["e"] >= threshold), lambda s: s["x"])
