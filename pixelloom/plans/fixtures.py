"""Tables that the queries start from, and the same in SQL.

Images are the 8x8 vectors of `embeddings`; the stego image adds 0.01 where (image_id * 7 + pos * 13) % 5 = 0; the cost of a
pixel is the population variance of its reflected 3x3 surroundings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.joins import around_places
from pixelloom.operators.projection import explode_pixels
from pixelloom.sources.images import vectors_as_images

SIDE = 8

#: Pixels in SQL: px(image_id, label, pos, i, j, v, d).
PX = """px AS (SELECT image_id, label, pos, pos // 8 AS i, pos % 8 AS j, v,
  CASE WHEN (image_id * 7 + pos * 13) % 5 = 0 THEN 1 ELSE 0 END AS d
  FROM (SELECT vec_id AS image_id, label::BIGINT AS label, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings))"""
#: Vectors in SQL: vx(id, label, f).
VX = "vx AS (SELECT vec_id AS id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"
#: The nine offsets in their order, and the surroundings: around(image_id, i, j, n, v).
AROUND = PX + """,
off(n, a, b) AS (VALUES (0, 0, 0), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, -1), (5, 0, 1), (6, 1, -1), (7, 1, 0), (8, 1, 1)),
want AS (SELECT image_id, i, j, d, n, CASE WHEN i + a < 0 THEN 1 WHEN i + a > 7 THEN 6 ELSE i + a END AS si,
  CASE WHEN j + b < 0 THEN 1 WHEN j + b > 7 THEN 6 ELSE j + b END AS sj FROM px, off),
around AS (SELECT w.image_id, w.i, w.j, w.d, w.n, p.v FROM want w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj)"""
RHO = AROUND + """,
rho AS (SELECT image_id, i, j, any_value(d) AS d, round(var_pop(v), 9) AS rho FROM around GROUP BY image_id, i, j)"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_as_images(read(spark, sf_dir, "embeddings"), SIDE)


def changed_flag():
    return F.when((F.col("image_id") * 7 + F.col("pos") * 13) % 5 == 0, 1).otherwise(0)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, pos, i, j, v, d)."""
    return explode_pixels(images(spark, sf_dir), "px", "w", "v", "label").withColumn("d", changed_flag())


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, f)."""
    return images(spark, sf_dir).select(F.col("image_id").alias("id"), "label", F.col("px").alias("f"))


def as_stored(spark: SparkSession, sf_dir: str) -> Callable[[Column], Column]:
    """Numbers that were computed back, in the precision that the table holds: those it holds come out exactly, so that rounding sees 1/64
    itself (a tie of the fifth decimal) and not 1/64 less what products of doubles lose."""
    kind = read(spark, sf_dir, "embeddings").schema["embedding"].dataType.elementType
    return lambda x: x.cast(kind).cast("double")


def image_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, costs): per image its pixels as an array of (rho, i, j, d)."""
    places = around_places(SIDE, SIDE)

    @F.pandas_udf("array<double>")
    def rho(px: pd.Series) -> pd.Series:
        if not len(px):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.round(np.stack(px.to_list())[:, places].var(axis=2), 9)))

    d = "CASE WHEN (image_id * 7 + pos * 13) % 5 = 0 THEN 1 ELSE 0 END"
    near = images(spark, sf_dir).where("px is not null").withColumn("rho", rho("px"))
    return near.select("image_id", F.expr(f"transform(rho, (r, pos) -> struct(r AS rho, cast(pos div {SIDE} AS int) AS i, cast(pos % {SIDE} AS int) AS j, {d} AS d))").alias("costs"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, i, j, rho, d)."""
    return image_costs(spark, sf_dir).select("image_id", F.inline("costs")).select("image_id", "i", "j", "rho", "d")
