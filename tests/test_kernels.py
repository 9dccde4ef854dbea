"""Grid kernels and transforms against plain numpy, and the reconstruction properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.operators import learn, projection, subspace, windows
from pixelloom.operators.metrics import reconstruction_error
from pixelloom.sources.config import HopSpec


def image(seed=0, h=8, w=8):
    return np.random.default_rng(seed).normal(size=(h, w))


@given(st.integers(0, 50), st.sampled_from(["symmetric", "reflect", "zero"]), st.sampled_from([3, 5]))
@settings(max_examples=30, deadline=None)
def test_windows_are_shifted_views(seed, border, size):
    x = image(seed)
    r = size // 2
    p = np.pad(x, r) if border == "zero" else np.pad(x, r, mode=border)
    got = grid.gather(x[:, :, None], size, border)
    for n in range(size * size):
        assert np.array_equal(got[:, :, n], p[n // size : n // size + 8, n % size : n % size + 8])


@given(st.integers(0, 50), st.sampled_from([2, 4]))
@settings(max_examples=20, deadline=None)
def test_blocks_come_back(seed, size):
    x = image(seed)[:, :, None]
    assert np.array_equal(grid.ungather(grid.gather(x, size, None, stride=size), size), x)


def test_pooling_fills_odd_edges_with_zeros():
    x = -np.ones((3, 3, 1))
    assert grid.pool(x)[:, :, 0].tolist() == [[-1, 0], [0, 0]]
    assert grid.pool(x, "avg")[:, :, 0].tolist() == [[-1, -0.5], [-0.5, -0.25]]


def test_thinning_keeps_the_first_in_raster_order():
    d = np.zeros((6, 6))
    d[0, 0] = d[0, 1] = d[1, 3] = d[5, 5] = 1
    assert np.argwhere(grid.thin(d, 1)).tolist() == [[0, 0], [1, 3], [5, 5]]


def test_ring_inverts_boxes_once():
    d = np.zeros((5, 5))
    d[2, 2] = 1
    out = grid.ring(d)
    assert out[2, 2] == 0 and out.sum() == 8


def test_picks_clear_their_neighbourhood():
    x = np.arange(25.0).reshape(5, 5)
    got = grid.picks(x, 3, 1)
    assert got[0] == (4, 4) and all(max(abs(a - c), abs(b - d)) > 1 for i, (a, b) in enumerate(got) for c, d in got[:i])


def test_dilation_and_hysteresis():
    x = np.zeros((5, 5))
    x[2, 2] = 1
    assert grid.dilate(x, 3).sum() == 9
    y = np.full((1, 4), 0.5)
    y[0, 0] = 1
    assert grid.hysteresis(np.pad(y, ((0, 0), (0, 0))), 0.4, 0.9).tolist() == [[1, 1, -1, -1]]


def test_residuals_of_a_flat_image_vanish():
    assert not grid.residual_maps(np.full((8, 8), 7.0)).any()


def test_costs_are_lower_in_texture():
    rng = np.random.default_rng(0)
    x = np.full((32, 32), 10.0)
    x[:, 16:] += rng.normal(size=(32, 16)) * 20
    c = grid.wavelet_cost(x + rng.normal(size=x.shape) * 1e-3)
    assert np.median(c[:, 20:]) < np.median(c[:, :10])


def vectors(spark, n=60, d=6, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d)) @ np.diag(np.arange(1, d + 1)) + 2
    return x, spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "id long, f array<double>, label long").repartition(3)


def test_moments_and_pca(spark):
    x, rows = vectors(spark)
    m = subspace.vector_moments(rows)
    assert m.n == 60 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x.T, bias=True)) and np.isclose(m.norm, np.linalg.norm(x, axis=1).max())
    p = subspace.PCA.fit(rows)
    assert np.allclose(p.energy, np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1])
    got = np.array([r.f for r in p.transform(rows).orderBy("id").collect()])
    assert np.allclose(got, x @ p.kernels.T)


@pytest.mark.parametrize("bias", [False, True])
def test_saab_inverse(spark, bias):
    _, rows = vectors(spark)
    s = subspace.Saab.fit(rows, use_dc=False, need_bias=bias)
    assert reconstruction_error(s.inverse(s.transform(rows.withColumn("g", F.col("f"))))).first()[0] < 1e-8


def test_saab_dc_and_variants(spark):
    x, rows = vectors(spark)
    s = subspace.Saab.fit(rows)
    assert np.isclose(s.bias, np.linalg.norm(x, axis=1).max() / np.sqrt(6)) and np.isclose(s.energy.sum(), 1) and len(s.kernels) == 6
    dc = x.mean(1)
    assert np.isclose(s.energy[0] / s.energy[1], np.var(dc * np.sqrt(6)) / np.linalg.eigvalsh(np.cov((x - dc[:, None]).T))[-1])
    v2 = subspace.Saab.fit(rows, variant="v2")
    y = x - x.mean(0)
    y = y - y.mean(1, keepdims=True)
    assert np.isclose(v2.bias, np.linalg.norm(y, axis=1).max() / np.sqrt(6)) and np.allclose(v2.mean, x.mean(0))
    with pytest.raises(ValueError):
        subspace.Saab.fit(rows, bits=8)


def images(spark, n=12):
    return spark.createDataFrame([(i, 8, 8, 1, image(i).ravel().tolist(), i % 2) for i in range(n)], "image_id long, h int, w int, c int, px array<double>, label long")


def test_tree_inverse_and_partitions(spark):
    hops = tuple(HopSpec(window=2, stride=2, border=None, use_dc=False) for _ in range(2))
    rows = images(spark)
    tree = subspace.fit_tree(rows, hops, -1.0)
    x = image(3)[:, :, None]
    assert np.abs(tree.invert(tree.responses(x)[-1]) - x).mean() < 1e-8
    other = subspace.fit_tree(rows.repartition(5), hops, -1.0)
    assert np.allclose(np.concatenate(tree.energy), np.concatenate(other.energy))
    assert tree.params(spark).count() == sum(len(u.kernels) for us in tree.units for u in us)


def test_child_energy_is_a_share_of_its_parent(spark):
    tree = subspace.fit_tree(images(spark), (HopSpec(window=2, stride=2, border=None), HopSpec(window=2, stride=2, border=None)), 0.1)
    parents = [e for e, s in zip(tree.energy[0], tree.split[1]) if s]
    assert np.allclose([u.energy.sum() for u in tree.units[1]], parents)


def test_pixels_round_trip(spark):
    rows = images(spark)
    back = projection.collect_pixels(projection.explode_pixels(rows))
    assert {r.image_id: r.px for r in back.collect()} == {r.image_id: r.px for r in rows.collect()}
    assert windows.features_of(rows).count() == 12 * 64


def test_least_squares(spark):
    x, rows = vectors(spark)
    w = learn.LeastSquares.fit(rows.withColumn("y", F.array(F.expr("2 * f[0] - f[1] + 3"), F.expr("f[2]")))).w
    assert np.allclose(w, np.array([[2, 0], [-1, 0], [0, 1], [0, 0], [0, 0], [0, 0], [3, 0]]), atol=1e-6)


def test_one_class_and_dense_labels(spark):
    _, rows = vectors(spark)
    assert learn.learn(rows.where("label = 1"), learn.logistic)(rows).where("prediction <> 1").count() == 0
    assert {r.dense for r in learn.dense_labels(rows.withColumn("label", F.col("label") * 5 + 3)).collect()} == {0, 1}


def test_surroundings_of_whole_images_are_those_of_pixel_rows(spark):
    from pixelloom.operators import joins as J
    from pixelloom.operators.projection import explode_pixels

    images = spark.createDataFrame([(i, [float((i * 7 + p * p) % 11) for p in range(12)], 3, 4, i) for i in range(5)], "image_id long, px array<double>, h int, w int, label int")
    a = J.surround_in_images(images, 3, 4)
    b = J.surround(explode_pixels(images, "px", "w", "v", "label"), 3, 4)
    assert sorted(map(str, a.select("image_id", "i", "j", "around").collect())) == sorted(map(str, b.select("image_id", "i", "j", "around").collect()))


def test_sweep_against_plain_lloyd(spark):
    """All runs of the sweep at once give what plain loops give from the same starts."""
    import numpy as np
    from pyspark.sql import functions as F

    from pixelloom.operators import cluster as L

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (40, 3)) for c in (0, 2, 5)])
    rows = spark.createDataFrame([(r.tolist(), int(i % 2)) for i, r in enumerate(x)], "f array<double>, label int").repartition(3)
    got = {(r.k, r.trial, r.cluster): r for r in L.sweep(rows, range(2, 4), 2, 3).collect()}
    for k in (2, 3):
        for t in range(2):
            c = np.array([r[0] for r in rows.orderBy(F.xxhash64("f", F.lit(t)), "f").limit(3).collect()])[:k]
            for _ in range(20):
                near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
                c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(k)])
            assert [got[k, t, j].n for j in range(k) if (k, t, j) in got] == [n for n in np.bincount(near, minlength=k).tolist() if n]
    assert L.sweep(rows.where("false"), range(2, 4), 2, 3).count() == 0


def test_batches_are_cut_and_handed_on_in_bounded_parts():
    """A full Arrow batch of images isn't blown up to all its windows and channels at once."""
    import pandas as pd

    from pixelloom.operators import subspace, windows

    class Images:  # hands out the function that runs in tasks
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run

    x = np.arange(5_000 * 64, dtype=float).reshape(5_000, 64)
    batch = pd.DataFrame({"image_id": range(5_000), "h": 8, "w": 8, "c": 1, "px": list(x)})
    made = list(windows.per_image(Images(), lambda v: np.repeat(v, 80, axis=2))(iter([batch, batch[:0]])))
    assert len(made) > 20 and max(sum(map(len, m["px"])) for m in made) < windows.HELD + 64 * 80
    made = pd.concat(made)
    assert made["image_id"].tolist() == list(range(5_000)) and set(made["c"]) == {80} and np.array_equal(np.stack(made["px"])[:, ::80], x)
    parts = list(subspace._parts(batch[["h", "w", "c", "px"]]))
    assert len(parts) > 4 and max(sum(map(len, p["px"])) for p in parts) <= subspace.PART
    assert np.array_equal(np.concatenate([np.stack(p["px"]) for p in parts]), x) and not list(subspace._parts(batch[:0]))
