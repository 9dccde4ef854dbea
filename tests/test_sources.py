import gc
import subprocess
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.sources import images as S


def make(spark, folder, shift=0, channels=1):
    rng = np.random.default_rng(5)
    px = {i: np.clip(rng.integers(0, 200, (6, 5, channels)) + shift, 0, 255).astype(float) for i in (2, 10, 7)}
    rows = spark.createDataFrame([(i, 6, 5, channels, x.ravel().tolist()) for i, x in px.items()], "image_id long, h int, w int, c int, px array<double>")
    assert S.write_images(rows, f"file://{folder}").count() == 3
    return px


def test_images_and_pairs(spark, tmp_path):
    cover, stego = make(spark, tmp_path / "c"), make(spark, tmp_path / "s", 1)
    got = {r.image_id: np.array(r.px).reshape(r.h, r.w, r.c) for r in S.read_images(spark, str(tmp_path / "c")).collect()}
    assert set(got) == set(cover) and all(np.array_equal(got[i], cover[i]) for i in got)
    pairs = S.read_pairs(spark, str(tmp_path / "c"), str(tmp_path / "s"), limit=2)
    assert sorted(r.image_id for r in pairs.collect()) == [2, 7]
    assert all(np.array_equal(np.array(r.stego) - np.array(r.cover), np.ones(30)) for r in pairs.collect())
    del stego


def test_colour_and_splices(spark, tmp_path):
    colour = make(spark, tmp_path / "x", channels=3)
    got = {r.image_id: r for r in S.read_images(spark, str(tmp_path / "x"), mode="colour").collect()}
    assert all(got[i].c == 3 and np.array_equal(np.array(got[i].px), colour[i].ravel()) for i in got)
    make(spark, tmp_path / "t")
    out = S.read_splices(spark, str(tmp_path / "x"), str(tmp_path / "t"), augment=True, truth_suffix="")
    assert out.count() == 15 and out.where("turn = 1").first().h == 5


def test_many_images_are_dealt_to_folders_and_scanned_in_turn(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("image_id"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.lit(1).alias("c"), F.array(*[(F.col("id") + k).cast("double") for k in range(4)]).alias("px"))
    folder = f"file://{tmp_path}/many"
    paths = [r.path for r in S.write_images(rows, folder, files=10).collect()]
    held = [len(list(p.iterdir())) for p in (tmp_path / "many").iterdir()]
    assert len(paths) == sum(held) == 100 and len(held) > 5 and max(held) < 30
    want = sorted((r.image_id, r.px) for r in rows.collect())
    for name in (folder, str(tmp_path / "many")):
        assert sorted((r.image_id, r.px) for r in S.read_images(spark, name).collect()) == want
    assert sorted(r.image_id for r in S.read_images(spark, folder, limit=12).collect()) == list(range(12))


@pytest.mark.parametrize("limit", [None, 40])
def test_the_driver_keeps_no_listings_of_scanned_folders(spark, tmp_path, limit):
    java = spark._jvm.System.getProperty("java.home")
    if not Path(f"{java}/bin/jcmd").exists():
        pytest.skip("no jcmd")

    def listed():
        seen = subprocess.run([f"{java}/bin/jcmd", str(spark._jvm.ProcessHandle.current().pid()), "GC.class_histogram"], capture_output=True, text=True, check=True).stdout
        return sum(int(x.split()[1]) for x in seen.splitlines() if "org.apache.hadoop.fs.LocatedFileStatus " in x + " ")

    rows = spark.range(400).select(F.col("id").alias("image_id"), F.lit(2).alias("h"), F.lit(2).alias("w"), F.lit(1).alias("c"), F.array(*[F.lit(1.0)] * 4).alias("px"))
    folder, keeps = f"file://{tmp_path}/many", spark.conf.get(S.LISTINGS)
    S.write_images(rows, folder, files=80)
    gc.collect()
    before = listed()
    read = S.read_images(spark, folder, limit=limit)
    assert listed() - before < 200  # of 400 files; those of tables that are open count too
    assert read.count() == (limit or 400) and spark.conf.get(S.LISTINGS) == keeps


def test_features_and_costs(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").alias("image_id"), F.lit(0).alias("i"), F.lit(1).alias("j"), (F.col("id") * 0.5).alias("rho"), F.lit("x").alias("extra"))
    S.write_features(rows, str(tmp_path / "f"))
    assert S.read_cost_maps(spark, str(tmp_path / "f")).columns == ["image_id", "i", "j", "rho"]
    assert S.read_features(spark, str(tmp_path / "f"), "rho").count() == 4


def test_lattice_keeps_the_sign_of_small_values(spark, tmp_path):
    """SQL rounds -3e-7 to -0.0, which is another value inside an array."""
    import duckdb

    from pixelloom.plans import registry

    rng = np.random.default_rng(3)
    rows = [(k, np.where(rng.random(64) < 0.3, rng.choice([-3e-7, 3e-7, 0.0, -0.0], 64), rng.normal(0, 0.1, 64)).tolist(), 1) for k in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute("SELECT image_id, bi, bj, f FROM (" + registry.oracle_sql()["lattice"] + ")").fetchall()
    got = registry.queries()["lattice"](spark, str(tmp_path)).select("image_id", "bi", "bj", "f").collect()
    assert sorted(repr((r.image_id, r.bi, r.bj, list(r.f))) for r in got) == sorted(repr((*r[:3], list(r[3]))) for r in want)
    assert any("-0.0," in repr(r[3]) for r in want)
