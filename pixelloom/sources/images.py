"""Image scans and sinks. Images are rows (image_id, variant, h, w, c, px) with px in raster order, channel last."""

from __future__ import annotations

import gc
import re
import struct
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.sources.scratch import shared_folder, written

#: About the most files that a sink puts into a folder. The driver lists a folder's files whole, so a scan takes one such folder at a time.
FILES = 8_192
#: Bytes of file listings that the driver keeps after a table was read.
LISTINGS = "spark.sql.hive.filesourcePartitionFileCacheSize"
IMAGES = "image_id long, name string, variant string, h int, w int, c int, px array<double>"


def read_images(spark: SparkSession, folder: str, variant: str = "", mode: str = "gray", limit: int | None = None, suffix: str = "") -> DataFrame:
    """All images of a folder whose names are numbers (before `suffix`), decoded by Spark's image source.

    The smallest `limit` ids are taken before anything is decoded. gray: luma of the channels, rounded. A folder that write_images dealt to
    numbered ones is scanned now, one of these after the other, into a table in the shared folder: what the driver lists doesn't grow with the
    images. The files of other folders are listed at once, as Spark's sources do."""
    parts, names = _folders(spark, folder), None
    if limit is not None:
        listed = (_named(spark.read.format("binaryFile").load(p).select("path"), suffix) for p in parts)
        names = (next(listed) if len(parts) == 1 else _gathered(spark, listed, "images-listed")).orderBy("image_id").limit(limit)
    if len(parts) == 1:
        return _scan(spark, folder, variant, mode, suffix, names)
    width = spark.sparkContext.defaultParallelism
    return _gathered(spark, (_scan(spark, p, variant, mode, suffix, names, width) for p in parts), "images-read")


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """The numbered folders in a folder that write_images dealt; else the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts, files = [], store.listStatusIterator(path) if store.exists(path) else None
    while files is not None and files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if not (f.isDirectory() and re.fullmatch(r"part-\d+", name)):
            return [folder]
        parts.append(f.getPath().toString())
    return sorted(parts) or [folder]


def _gathered(spark: SparkSession, tables: Iterable[DataFrame], name: str) -> DataFrame:
    """Tables written one after the other into one, which is read again. Each is made when its turn comes, and the driver keeps no listing of
    its files: Spark is told not to (it would hold up to 250 MB, though nobody reads those folders again), and Python frees a table."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(LISTINGS)
    spark.conf.set(LISTINGS, "0")
    try:
        for t in tables:
            t.write.mode("append").parquet(path)
            schema = t.schema
            del t
            gc.collect()  # tables are parts of reference cycles, and hold their listings in the JVM until these are found
    finally:
        spark.conf.set(LISTINGS, kept)
    return spark.read.schema(schema).parquet(path)


def _named(files: DataFrame, suffix: str) -> DataFrame:
    """Files (path, ..) with the name before the suffix and the number it ends with; others are left out."""
    stem = F.regexp_extract("path", rf"([^/]*?){suffix}\.[A-Za-z]+$", 1)
    named = files.withColumns({"name": stem, "image_id": F.regexp_extract(stem, r"(\d+)$", 1).cast("long"), "path": F.regexp_replace("path", "^file:/+", "/")})
    return named.where("image_id is not null")


def _scan(spark: SparkSession, folder: str, variant: str, mode: str, suffix: str, names: DataFrame | None, width: int | None = None) -> DataFrame:
    """The images of one folder; names: only those of these paths; width: in so many tasks, and not in one for every few files."""
    data = spark.read.format("image").load(folder).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    rows = _named(data, suffix)
    if names is not None:
        rows = rows.join(names.select("path"), "path", "left_semi")

    def decode(batches):
        for b in batches:
            px, c = [], []
            for data, h, w, n in zip(b["data"], b["height"], b["width"], b["nChannels"]):
                x = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.float64)
                if n == 4:
                    x = x[:, :, :3]
                if x.shape[2] == 3:
                    x = x[:, :, ::-1]  # stored blue first
                    if mode == "gray":
                        x = np.rint(x @ np.array([0.299, 0.587, 0.114]))[:, :, None]
                elif mode != "gray":
                    x = np.repeat(x, 3, axis=2)
                px.append(x.ravel())
                c.append(x.shape[2])
            yield pd.DataFrame({"image_id": b["image_id"], "name": b["name"], "variant": variant, "h": b["height"], "w": b["width"], "c": c, "px": px})

    rows = rows.drop("path")
    return (rows if width is None else rows.coalesce(width)).mapInPandas(decode, IMAGES)


def read_pairs(spark: SparkSession, cover_dir: str, stego_dir: str, mode: str = "gray", limit: int | None = None) -> DataFrame:
    """Cover images with the stego image of the same id: (image_id, h, w, c, cover, stego)."""
    cover = read_images(spark, cover_dir, "cover", mode, limit)
    stego = read_images(spark, stego_dir, "stego", mode)
    return cover.join(stego.select("image_id", F.col("px").alias("stego")), "image_id").select("image_id", "h", "w", "c", F.col("px").alias("cover"), "stego")


def read_splices(spark: SparkSession, image_dir: str, truth_dir: str, edge_dir: str | None = None, augment: bool = False, truth_suffix: str = "_gc") -> DataFrame:
    """Colour images with their truth masks (name plus suffix) and edge maps; augment adds a flip and three turns."""
    images = read_images(spark, image_dir, "splice", "colour")
    truth = read_images(spark, truth_dir, "truth", "gray", suffix=truth_suffix).select("image_id", F.transform("px", lambda x: (x > 0).cast("double")).alias("gt"))
    out = images.join(truth, "image_id")
    if edge_dir:
        out = out.join(read_images(spark, edge_dir, "edge").select("image_id", F.col("px").alias("edge")), "image_id")
    if not augment:
        return out.withColumn("turn", F.lit(0))
    planes = ["px", "gt"] + (["edge"] if edge_dir else [])

    def turn(batches):
        for b in batches:
            for k in range(5):
                made = b.copy()
                for col in planes:
                    made[col] = [np.ravel(_turn(np.asarray(x).reshape(h, w, -1), k)) for x, h, w in zip(b[col], b["h"], b["w"])]
                if k % 2:
                    made["h"], made["w"] = b["w"], b["h"]
                yield made.assign(turn=k)

    return out.mapInPandas(turn, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", turn int")


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    """0 to 3: quarter turns; 4: a left-right flip."""
    return np.flip(x, 1) if k == 4 else np.rot90(x, k)


def png_bytes(x: np.ndarray) -> bytes:
    """An 8-bit gray or RGB image as PNG."""
    x = np.clip(np.rint(x), 0, 255).astype(np.uint8)
    h, w, c = x.shape
    raw = b"".join(b"\0" + x[i].tobytes() for i in range(h))

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def write_images(images: DataFrame, folder: str, files: int = FILES) -> DataFrame:
    """Write one PNG per image on the executors, now; written rows (image_id, path). A file is written under a name of its own and renamed when it
    is whole, so a repeated task replaces it and readers never see a part. Images without pixels have no file. More than `files` images are
    dealt by their ids to numbered folders of about so many."""
    from pyarrow import fs as pafs

    def write(batches):
        for b in batches:
            store, root = pafs.FileSystem.from_uri(folder)
            for own in set(b["own"]):
                store.create_dir(root + own, recursive=True)
            paths = []
            for i, own, h, w, c, px in zip(b["image_id"], b["own"], b["h"], b["w"], b["c"], b["px"]):
                part = f"{root}/_{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(png_bytes(np.asarray(px).reshape(h, w, c)))
                store.move(part, f"{root}{own}/{i}.png")
                paths.append(f"{folder}{own}/{i}.png")
            yield pd.DataFrame({"image_id": b["image_id"], "path": paths})

    there = images.where("px is not null")
    parts = -(-there.count() // files)
    own = F.format_string("/part-%06d", F.expr(f"pmod(xxhash64(image_id), {parts})")) if parts > 1 else F.lit("")
    return written(there.select("image_id", own.alias("own"), "h", "w", "c", "px").mapInPandas(write, "image_id long, path string"), "images-written")


def read_cost_maps(spark: SparkSession, path: str) -> DataFrame:
    """Cost maps as rows (image_id, i, j, rho) from Parquet; matrices of other tools are converted to it once."""
    return spark.read.parquet(path).select(F.col("image_id").cast("long"), F.col("i").cast("long"), F.col("j").cast("long"), F.col("rho").cast("double"))


def write_features(features: DataFrame, path: str) -> None:
    """Feature tables between steps: Parquet, one column per hop, so that later steps read only the hops they use."""
    features.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def vectors_as_images(table: DataFrame, side: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of side x side numbers as gray images with their label: the bundled small image set."""
    return table.select(
        F.col(id_col).cast("long").alias("image_id"), F.lit(side).alias("h"), F.lit(side).alias("w"), F.lit(1).alias("c"),
        F.col(vector_col).cast("array<double>").alias("px"), F.col("label").cast("long").alias("label"),
    )


def normalized_edges(edges: DataFrame) -> DataFrame:
    """Edge maps whose values sum to 1 per image."""
    from pixelloom.functions.vector import total

    return edges.withColumn("px", F.transform("px", lambda x: x / total(F.col("px"))))
