"""Empty tables, null vectors, null labels: nothing crashes, nulls take no part in fits, and their outputs are null."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import cluster, filters, image, learn, metrics, sampling, select, subspace, topk, trees, windows
from pixelloom.sources.config import HopSpec

SCHEMA = "id long, f array<double>, label long"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=4) + 2 * (i % 2)).tolist(), i % 2) for i in range(60)]
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 0), (102, [0.0, 1.0, 0.0, 1.0], None), (None, None, None)]
    made = lambda r: spark.createDataFrame(r, SCHEMA).repartition(2).cache()
    return {"clean": made(rows), "nulls": made(rows + odd), "empty": made(rows).where("false")}


def parts(model):
    """A model as comparable arrays."""
    return [np.asarray(v, float) for v in vars(model).values() if isinstance(v, (np.ndarray, float, int)) and not isinstance(v, bool)]


#: Fits whose labels play no part: the row with a null label counts.
UNLABELLED = {
    "pca": lambda t: subspace.PCA.fit(t),
    "saab": lambda t: subspace.Saab.fit(t),
    "saab_v2": lambda t: subspace.Saab.fit(t, variant="v2"),
    "saab_v1": lambda t: subspace.Saab.fit(t, variant="v1", energy_percent=0.9),
    "residual": lambda t: subspace.ResidualPCA.fit(t, 0.5),
}
#: Fits on labels.
LABELLED = {
    "least_squares": lambda t: learn.LeastSquares.fit(t.withColumn("y", F.when(F.col("label").isNotNull(), F.array(F.col("label").cast("double"))))),
    "weighted": lambda t: learn.LeastSquares.fit(t.withColumn("y", F.when(F.col("label").isNotNull(), F.array(F.col("label").cast("double")))).withColumn("w", F.lit(2.0)), weight="w"),
    "radial": lambda t: learn.RadialSVC.fit(t, 4, 0.5, landmarks=20),
}
#: Learners as functions on tables.
MODELS = {
    "classifier": lambda t: learn.fit_classifier(t, 2),
    "forest": lambda t: learn.forest(t, trees=3, depth=3),
    "forest_regressor": lambda t: learn.forest_regressor(t, y="label", trees=3, depth=3),
    "boosted": lambda t: learn.boosted(t, maxIter=2),
    "logistic": lambda t: learn.logistic(t),
    "linear": lambda t: learn.linear(t, y="label"),
    "radial": lambda t: learn.RadialSVC.fit(t, 4, 0.5, landmarks=20),
}


@pytest.mark.parametrize("name", sorted(UNLABELLED) + sorted(LABELLED))
def test_fits(tables, name):
    fit = (UNLABELLED | LABELLED)[name]
    clean = tables["clean"].unionByName(tables["nulls"].where("id = 102")) if name in UNLABELLED else tables["clean"]
    want, got = parts(fit(clean)), parts(fit(tables["nulls"]))
    assert want and all(a.shape == b.shape and np.allclose(a, b, atol=1e-6) for a, b in zip(want, got))
    none = fit(tables["empty"])
    if hasattr(none, "transform"):
        assert none.transform(tables["empty"]).count() == 0
        assert all(len(r.g or []) == 0 for r in none.transform(tables["nulls"], out="g").collect())


@pytest.mark.parametrize("name", ["pca", "saab", "saab_v2", "residual"])
def test_null_vectors_stay_null(tables, name):
    model = UNLABELLED[name](tables["clean"])
    out = {r.id: r.g for r in model.transform(tables["nulls"], out="g").collect()}
    assert out[100] is None and out[None] is None and out[0] is not None and len(out) == 64


@pytest.mark.parametrize("name", sorted(MODELS))
def test_models(tables, name):
    want = {r.id: r.prediction for r in MODELS[name](tables["clean"])(tables["clean"]).collect()}
    out = {r.id: r.prediction for r in MODELS[name](tables["nulls"])(tables["nulls"]).collect()}
    assert len(out) == 64 and out[100] is None and out[None] is None and out[102] is not None
    if name in ("classifier", "linear", "logistic"):
        assert all(np.isclose(out[i], v, atol=1e-4) for i, v in want.items())
    none = MODELS[name](tables["empty"])
    assert none(tables["empty"]).count() == 0
    assert {r.prediction for r in none(tables["nulls"]).collect()} <= {None, 0.0}


@pytest.mark.parametrize("kind", ["nulls", "empty"])
def test_clusters_and_selection(tables, kind):
    t, n = tables[kind], 61 if kind == "nulls" else 0
    assert cluster.kmeans(t, 2)[0].count() == n and cluster.kmeans(t, 1)[0].count() == n
    assert cluster.minibatch_kmeans(t, 2)[0].count() == n
    assert cluster.sweep(t.where("label is not null"), range(2, 3), 1, 4).where("n is null").count() == 0
    assert learn.LabelAssisted.fit(t, 2, 1).predict(t).count() >= n
    assert select.forest_entropy(t, 4).count() == (4 if n else 0)
    assert select.importances(t, trees=2, depth=2).count() == (4 if n else 0)
    whole = t.where("id < 100")
    assert select.bin_entropy(whole, 2).count() == select.correct_class_entropy(whole).count() == select.mutual_information(whole).count() == (4 if n else 0)
    assert select.cluster_entropy(whole, 2, 2).count() == 1
    assert metrics.accuracy(t.withColumn("prediction", F.col("label"))).count() == 1
    assert learn.learn(t, learn.logistic)(t).count() == t.count()
    assert sampling.stratified_folds(t.where("id is not null"), "id", 3).where("fold is null").count() == 0
    assert trees.grow(t, 4, 3, "error", 2)[0].count() == n
    assert subspace.standardize(t.where("id < 100")).count() == (60 if n else 0)


def test_images(spark):
    """Images without pixels take no part; an empty table gives empty ones."""
    rng = np.random.default_rng(1)
    kind = "image_id long, h int, w int, c int, px array<double>, label long"
    rows = [(i, 8, 8, 1, rng.normal(size=64).tolist(), i % 2) for i in range(10)]
    clean, nulls = spark.createDataFrame(rows, kind), spark.createDataFrame([*rows, (50, 8, 8, 1, None, 0)], kind)
    hops = (HopSpec(window=2, stride=2, border=None), HopSpec(window=2, stride=2, border=None))
    a, b = (subspace.PixelHop.fit(t, hops, 0.02, 0.001) for t in (clean, nulls))
    assert all(np.allclose(x, y) for x, y in zip(a.tree.energy, b.tree.energy))
    assert b.transform(nulls)[0].count() == 10 and b.context(nulls, 8, 8).count() == 10
    none = clean.where("false")
    empty = subspace.PixelHop.fit(none, hops)
    assert empty.tree.units == [] and empty.transform(none) == []
    assert subspace.dilated_tree(none, 0.1).nodes == {} and subspace.MultiSaab.fit(nulls, (3,)).kernels[0].shape == (10, 9)
    for t in (none, clean):
        n = t.count()
        assert image.dense_sift(t, 4).count() == 4 * n and image.canny(t, 0.1, 0.2).count() == n
        assert topk.separated_extremes(t, 2, 1).count() == 2 * n and windows.hard_ring(t, 1).count() == n
        assert filters.changed_windows(t.withColumnRenamed("px", "diff"), 4, 9.9).count() == 0


def test_joint_layers_callbacks_and_window_means(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 8, 8))
    rows = spark.createDataFrame([(i, 8, 8, 1, v.ravel().tolist()) for i, v in enumerate(x)], "image_id long, h int, w int, c int, px array<double>")
    blocks = lambda v, hop: v.reshape(v.shape[0] // 2, 2, v.shape[1] // 2, 2, -1).swapaxes(1, 2).reshape(v.shape[0] // 2, v.shape[1] // 2, -1)
    back = lambda v, hop: v.reshape(*v.shape[:2], 2, 2, -1).swapaxes(1, 2).reshape(v.shape[0] * 2, v.shape[1] * 2, -1)
    own = tuple(HopSpec(use_dc=False, channelwise=c, gather=blocks, ungather=back) for c in (True, False))
    tree = subspace.fit_tree(rows, own, -1.0)
    assert len(tree.units[1]) == 1 and len(tree.units[1][0].kernels) == 16
    p = np.concatenate([blocks(blocks(v[:, :, None], None) @ tree.units[0][0].kernels.T + tree.units[0][0].bias * tree.units[0][0].kernels.sum(axis=1), None).reshape(-1, 16) for v in x])
    energies = np.sort(np.linalg.eigvalsh(np.cov(p.T)))[::-1]
    assert np.allclose(tree.energy[1], energies / energies.sum())
    hops = subspace.PixelHop(tree, 0.0)
    got = {r.image_id: np.reshape(r.px, (8, 8)) for r in hops.inverse(hops.transform(rows)[-1]).collect()}
    assert all(np.allclose(got[i], v) for i, v in enumerate(x))
    hop = HopSpec(window=2, stride=2, border=None)
    middle = float(np.median(subspace.fit_tree(rows, (hop,)).energy[0]))
    plain = subspace.fit_tree(rows, (hop, hop), middle, "below")
    assert plain.split[1] == [bool(e < middle) for e in plain.energy[0]] and any(plain.split[1])
    least = float(subspace.fit_tree(rows, (hop,)).energy[0].max())
    assert sum(subspace.fit_tree(rows, (hop, hop), least, "at_least").split[1]) == 1
    means = plain.window_means(x[0][:, :, None])
    assert np.allclose(means[0][:, :, 0], x[0].reshape(4, 2, 4, 2).mean(axis=(1, 3))) and means[1].shape == (2, 2, sum(plain.split[1]))


def test_dilated_tree_by_levels(spark):
    """Nodes fitted together equal those fitted one after the other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 10, 10)).cumsum(axis=1)
    rows = spark.createDataFrame([(i, 10, 10, 1, v.ravel().tolist()) for i, v in enumerate(x)], "image_id long, h int, w int, c int, px array<double>").repartition(2)
    tree = subspace.dilated_tree(rows, 0.05, (1, 2))
    from pixelloom.functions import grid

    cut = [grid.neighbours(v[:, :, None], 1, 1) for v in x]
    root = np.concatenate([c.reshape(-1, 9) for c in cut])
    assert np.isclose(tree.nodes["R"].bias, np.linalg.norm(root, axis=1).max() / 3)
    grown = [c for c in range(9) if c not in tree.leaves["R"]]
    assert set(tree.nodes) == {"R", *(f"R.{c}" for c in grown)} and grown
    for c in grown:
        below = np.concatenate([grid.neighbours(tree.nodes["R"].apply(v)[:, :, c : c + 1], 1, 2).reshape(-1, 9) for v in cut])
        assert np.isclose(tree.nodes[f"R.{c}"].bias, np.linalg.norm(below, axis=1).max() / 3)
        assert np.isclose(tree.energy[f"R.{c}"].sum(), tree.energy["R"][c]) and len(tree.leaves[f"R.{c}"]) == 9
    assert tree.transform(rows).first().c == sum(len(v) for v in tree.leaves.values())


def test_hop_units_by_plain_numpy(spark, tmp_path):
    """Two hops: moments, energies, biases, the channels passed on, and the responses; also after the model store."""
    from pixelloom.functions import grid
    from pixelloom.operators.hop_unit import above, below, fit_chain
    from pixelloom.sources import models

    rng = np.random.default_rng(6)
    x = rng.normal(size=(9, 7, 7, 2)).cumsum(axis=1)
    rows = spark.createDataFrame([(i, 7, 7, 2, v.ravel().tolist()) for i, v in enumerate(x)] + [(99, 7, 7, 2, None)], "image_id long, h int, w int, c int, px array<double>").repartition(2)
    chain = fit_chain(rows, [{"reach": 1}, {"reach": 1, "dilate": 2}], 0.9, below(0.3))
    assert [u.passed for u in chain.units][0] == [0, 1]
    now, before = [v for v in x], np.ones(2)
    for k, (unit, dilate) in enumerate(zip(chain.units, (1, 2))):
        passed = [0, 1] if k == 0 else np.flatnonzero(before < 0.3).tolist()
        assert unit.passed == passed and passed
        out, energy = [[] for _ in now], []
        for s, c in zip(unit.saabs, passed):
            w = [grid.neighbours(v[:, :, c : c + 1], 1, dilate) for v in now]
            p = np.concatenate([v.reshape(-1, 9) for v in w])
            z = p - p.mean(axis=0)
            z = z - z.mean(axis=1, keepdims=True)
            values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
            assert np.allclose(s.mean, p.mean(axis=0)) and np.isclose(s.bias, np.linalg.norm((p - p.mean(axis=0)) @ s.kernels.T, axis=1).max())
            assert len(s.kernels) <= max(1, (np.cumsum(np.maximum(values, 0)) / values.sum() <= 0.9).sum()) + 1 and np.isclose(s.energy.sum(), 1)
            energy.append(s.energy * before[c])
            for i, v in enumerate(w):
                y = (v + s.bias * (k > 0)) @ s.kernels.T
                y[:, :, 0] -= s.bias * (k > 0)
                out[i].append(y)
        before = np.concatenate(energy)
        assert np.allclose(unit.energy, before)
        now = [np.concatenate(o, axis=2) for o in out]
    models.save(spark, chain, f"file://{tmp_path}/m")
    for c in (chain, models.load(spark, f"file://{tmp_path}/m")):
        got = {r.image_id: np.reshape(r.px, (r.h, r.w, r.c)) for r in c.transform(rows).collect()}
        assert len(got) == 9 and all(np.allclose(got[i], v) for i, v in enumerate(now))
    assert fit_chain(rows.where("false"), [{}]).units == []
    assert len(fit_chain(rows, [{"reach": 1, "channelwise": False}, {"reach": 1}], passes=above(2.0)).units) == 1


def test_raw_targets(spark, tables):
    model = learn.LabelAssisted.fit(tables["clean"], 2, 2, encode="raw")
    out = model.transform(tables["nulls"]).collect()
    assert {len(r.lag) for r in out if r.lag is not None} == {1} and len(model.centres) == 4
