"""Learners, estimators and their helpers against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.functions.forest import Forest
from pixelloom.operators import cluster, image, information, joins, lag_unit, learn, metrics, ranks, sampling, subspace, topk, trees
from pixelloom.operators.subspace import per_image
from pixelloom.sources import models
from pixelloom.sources.config import HopSpec


@pytest.fixture(scope="module")
def many_tasks(spark):
    """Small tables over several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def labelled(spark, n=240, d=4, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    x = rng.normal(size=(n, d)) + 1.5 * np.eye(classes, d)[y] + 2.0 * rng.integers(0, 2, size=(n, 1))
    return x, y, spark.createDataFrame([(i, v.tolist(), int(c), "clash") for i, (v, c) in enumerate(zip(x, y))], "id long, f array<double>, label long, node string").repartition(3)


# ---- label-assisted unit ------------------------------------------------------------------------


def plain_means(x, c, steps=10):
    cost = np.inf
    for _ in range(steps):
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        near, now = far.argmin(axis=1), far.min(axis=1).sum()
        new = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        done = np.abs(new - c).max() < 1e-6 or cost - now <= 1e-6 * max(1, now)
        c, cost = new, now
        if done:
            break
    return c, ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)


def plain_unit(x, y, classes, per, alpha, rounds, threshold, least, bins):
    """Row by row: clusters, targets, least squares, entropies, splits."""
    centres, owner, member = [], [], np.zeros(len(x), int)
    for c in range(classes):
        own = np.flatnonzero(y == c)
        found, near = plain_means(x[own], x[own[:per]])
        member[own] = near + len(centres)
        centres += list(found)
        owner += [c] * per
    z = (x - x.mean(0)) / x.std(0)
    out = []
    while True:
        t = np.zeros((len(x), len(centres)))
        for i in range(len(x)):
            mine = [k for k, o in enumerate(owner) if o == y[i]]
            d = np.array([np.linalg.norm(x[i] - centres[k]) for k in mine])
            e = np.exp(-alpha * d / (d.min() + 1e-5))
            t[i, mine] = e / e.sum()
        w = np.linalg.lstsq(np.column_stack([z, np.ones(len(x))]), t, rcond=None)[0]
        o = z @ w[:-1] + w[-1]
        entropy = []
        for j in range(o.shape[1]):
            v = (o[:, j] - o[:, j].min()) / (o[:, j].max() - o[:, j].min())
            counts = np.zeros((bins, classes))
            for a, c in zip(v, y):
                counts[max(0, int(np.ceil(a * bins)) - 1), c] += 1
            lead = (counts / np.bincount(y, minlength=classes)).argmax(axis=1)
            entropy.append(sum(-np.log((lead == c).mean() + 1e-9) for c in y))
        if out and max(entropy) >= max(out[-1][0]):
            return out
        out.append((entropy, w, np.bincount(member, minlength=len(centres))))
        if len(out) > rounds or max(entropy) <= threshold or out[-1][2].min() < least:
            return out
        worst = [k for k in range(len(centres)) if entropy[k] == max(entropy)]
        new, own_, member_ = [], [], member.copy()
        for k in range(len(centres)):
            rows = np.flatnonzero(member == k)
            if k in worst:
                halves, near = plain_means(x[rows], np.array([x[rows].mean(0) - x[rows].std(0), x[rows].mean(0) + x[rows].std(0)]))
                member_[rows] = len(new) + near
                new += list(halves)
            else:
                member_[rows] = len(new)
                new.append(centres[k])
            own_ += [owner[k]] * (len(new) - len(own_))
        centres, owner, member = new, own_, member_


@pytest.mark.parametrize("seed, least", [(0, 5), (1, 5), (2, 40)])
def test_lag_unit(spark, seed, least):
    x, y, rows = labelled(spark, seed=seed)
    unit = lag_unit.LagUnit.fit(rows, 4, 3, 2, threshold=1.0, least=least, order=F.lpad(F.col("id").cast("string"), 6, "0"))
    want = plain_unit(x, y, 3, 2, 10.0, 10, 1.0, least, 10)
    assert len(unit.rounds) == len(want)
    for r, (entropy, w, sizes) in zip(unit.rounds, want):
        assert r.sizes.tolist() == sizes.tolist() and np.allclose(r.entropy, entropy) and np.allclose(r.w, w, atol=1e-8)
    worst = [r.entropy.max() for r in unit.rounds]
    assert all(b < a for a, b in zip(worst, worst[1:]))
    got = np.array([r.lag for r in unit.transform(rows).orderBy("id").collect()])
    assert np.allclose(got, ((x - x.mean(0)) / x.std(0)) @ want[-1][1][:-1] + want[-1][1][-1], atol=1e-8)


def test_lag_unit_splits_more_than_once(spark):
    x, y, rows = labelled(spark, seed=0)
    unit = lag_unit.LagUnit.fit(rows, 4, 3, 1, threshold=1.0, least=5, must_fall=False, rounds=4)
    assert [len(r.owner) for r in unit.rounds] == [3, 4, 5, 6, 7][: len(unit.rounds)] and len(unit.rounds) > 2
    assert all(r.sizes.sum() == len(x) for r in unit.rounds)


def test_lag_unit_odd_rows(spark):
    _, _, rows = labelled(spark, 60)
    more = rows.unionByName(spark.createDataFrame([(900, None, 1, ""), (901, [1.0, None, 2.0, 3.0], 1, ""), (902, [1.0, 1.0, 1.0, 1.0], None, "")], rows.schema))
    a, b = (lag_unit.LagUnit.fit(t, 4, 3, 1, threshold=1.0, rounds=1) for t in (rows, more))
    assert np.allclose(a.rounds[-1].w, b.rounds[-1].w) and a.transform(more).count() == 61
    none = lag_unit.LagUnit.fit(rows.where("false"), 4, 3, 2)
    assert none.rounds == [] and none.transform(rows).where("lag is not null").count() == 0


# ---- information --------------------------------------------------------------------------------


def plain_information(x, y, k):
    from math import fsum

    keep = np.array([(y == c).sum() > 1 for c in y])
    x, y = x[keep], y[keep]
    psi = lambda n: -0.5772156649015329 + fsum(1 / i for i in range(1, int(n)))
    a = 0.0
    for i in range(len(x)):
        own = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]
        j = min(k, len(own))
        r = own[j - 1]
        m = (np.abs(x - x[i]) < r).sum() if r > 0 else (x == x[i]).sum()
        a += psi(j) - psi((y == y[i]).sum()) - psi(m)
    return max(0.0, psi(len(x)) + a / len(x))


@pytest.mark.parametrize("ties", [False, True])
def test_neighbour_information(spark, many_tasks, ties):
    """500 rows over several tasks: informative, useless, constant, tied and widely scaled features; a class of one row and one of two."""
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.integers(0, 3, 497), [7, 8, 8]])
    x = np.column_stack([y + rng.normal(size=500), rng.normal(size=500), np.full(500, 2.5), rng.integers(0, 4, 500) + (y == 1), rng.normal(size=500) * 10.0 ** rng.integers(-200, 200, 500)])
    if ties:
        x = np.round(x, 1)
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)] + [(None, 1), ([1.0, 2.0, 3.0, 4.0, None], 1), ([1.0] * 5, None)], "f array<double>, label long").repartition(3)
    got = {r["feature"]: r["mi"] for r in information.neighbour_information(rows, 5, 3).collect()}
    assert got.keys() == set(range(5))
    for j in range(5):
        assert np.isclose(got[j], plain_information(x[:, j], y, 3), atol=1e-9), j
    assert information.neighbour_information(rows.where("false"), 5).count() == 0


def test_no_task_holds_a_feature(spark, many_tasks):
    """A single feature of a single class is dealt over all tasks."""
    rows = spark.range(4_000).select(F.array((F.xxhash64("id") % 1000).cast("double")).alias("f"), F.lit(1).alias("label"))
    seen, real = [], information.written
    try:
        information.written = lambda df, name: seen.append((name, real(df, name))) or seen[-1][1]
        information.neighbour_information(rows, 1).collect()
    finally:
        information.written = real
    tables = dict(seen)
    per = [r["n"] for r in tables["information-runs"].groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(per) == 4 and max(per) < 2_000
    assert tables["information-runs"].where("kind = 1").count() <= 4 * 4 * 3


# ---- radial machine -----------------------------------------------------------------------------


def exact_machine(k, s, c, steps=200_000):
    """Dual of the hinge loss by pairs of largest violation: (objective, bias)."""
    a, g = np.zeros(len(s)), -np.ones(len(s))
    q = (s[:, None] * s) * k
    for _ in range(steps):
        up, low = (a < c) & (s > 0) | (a > 0) & (s < 0), (a < c) & (s < 0) | (a > 0) & (s > 0)
        v = -s * g
        i, j = np.flatnonzero(up)[v[up].argmax()], np.flatnonzero(low)[v[low].argmin()]
        if v[i] - v[j] < 1e-7:
            break
        t = (v[i] - v[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        t = min(t, c - a[i] if s[i] > 0 else a[i], a[j] if s[j] > 0 else c - a[j])
        a[i] += s[i] * t
        a[j] -= s[j] * t
        g += q[:, i] * s[i] * t - q[:, j] * s[j] * t
    f = k @ (a * s)
    bias = (v[i] + v[j]) / 2
    return float((a * s) @ f / 2 + c * np.maximum(0, 1 - s * (f + bias)).sum())


def test_radial_svc_reaches_the_exact_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (500, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) + rng.normal(scale=0.25, size=500) < 1.3).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id long, f array<double>, label long").repartition(2)
    k = learn._radial(x, x, 0.8)
    want = exact_machine(k, 2.0 * y - 1, 1.0)
    whole = learn.RadialSVC.fit(rows, 2, 0.8, 1.0, landmarks=500)
    assert abs(whole.residual) < 1e-6 and want * 0.999 <= whole.objective(rows, 1.0) <= 1.01 * want
    few = learn.RadialSVC.fit(rows, 2, 0.8, 1.0, landmarks=60)
    assert 0 <= few.residual < 0.05 and few.objective(rows, 1.0) < 1.1 * want
    assert few(rows).where("prediction = label").count() > 420


def test_radial_svc_odd_rows(spark):
    rows = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, None, 1), (4, [None], 0), (5, [0.5], None)], "id long, f array<double>, label long")
    out = {r["id"]: r["prediction"] for r in learn.RadialSVC.fit(rows, 1, 1.0, 100.0)(rows).collect()}
    assert out[1] == 0 and out[2] == 1 and out[3] is None and out[4] is None and out[5] is not None
    assert {r["prediction"] for r in learn.RadialSVC.fit(rows.where("label = 1"), 1)(rows.where("id < 3")).collect()} == {1.0}
    assert {r["prediction"] for r in learn.RadialSVC.fit(rows.where("false"), 1)(rows.where("id < 3")).collect()} == {0.0}


# ---- descriptors, subspaces ---------------------------------------------------------------------


def loop_sift(x, size, cell, blur):
    y = grid.gaussian(x, np.sqrt(blur**2 - 0.25))
    out = []
    for ci in range(size // 2, x.shape[0] - size + size // 2 + 1, size):
        for cj in range(size // 2, x.shape[1] - size + size // 2 + 1, size):
            hist = np.zeros((4, 4, 8))
            for i in range(1, x.shape[0] - 1):
                for j in range(1, x.shape[1] - 1):
                    dx, dy = y[i, j + 1] - y[i, j - 1], y[i - 1, j] - y[i + 1, j]
                    r, c = (i - ci) / cell, (j - cj) / cell
                    weight = np.hypot(dx, dy) * np.exp(-(r * r + c * c) / 8)
                    angle = np.arctan2(dy, dx) / (2 * np.pi) * 8 % 8
                    for a in range(4):
                        for b in range(4):
                            for o in range(8):
                                turn = min((angle - o) % 8, (o - angle) % 8)
                                share = [max(0.0, 1 - abs(r + 1.5 - a)), max(0.0, 1 - abs(c + 1.5 - b)), max(0.0, 1 - turn)]
                                hist[a, b, o] += weight * share[0] * share[1] * share[2]
            d = hist.ravel()
            d = np.minimum(d, 0.2 * np.linalg.norm(d))
            out.append(d / np.linalg.norm(d))
    return np.array(out)


def test_sift_by_loops(spark):
    x = np.random.default_rng(1).normal(size=(14, 17)) * 50
    for cell in (6.0, 2.0):
        assert np.abs(grid.sift(x, 4, cell).reshape(-1, 128) - loop_sift(x, 4, cell, 1.6)).max() < 1e-9
    assert not grid.sift(np.full((8, 8), 3.0), 4).any()
    rows = spark.createDataFrame([(1, 14, 17, 1, x.ravel().tolist()), (2, 2, 2, 1, [0.0] * 4), (3, 4, 4, 1, None)], "image_id long, h int, w int, c int, px array<double>")
    got = image.dense_sift(rows, 4).orderBy("image_id", "bi", "bj").collect()
    assert [(r.image_id, r.bi, r.bj) for r in got] == [(1, i, j) for i in range(3) for j in range(4)]
    assert np.allclose([r.f for r in got], grid.sift(x, 4).reshape(-1, 128))


def pictures(spark, n=20, side=8):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, side, side)).cumsum(axis=1)
    return x, spark.createDataFrame([(i, side, side, 1, v.ravel().tolist(), i % 2) for i, v in enumerate(x)], "image_id long, h int, w int, c int, px array<double>, label long").repartition(3)


def test_kernels_chosen_by_frequency(spark):
    _, rows = pictures(spark)
    cut = per_image(rows, lambda x: grid.gather(x, 5, "reflect")).select(F.expr("explode(transform(sequence(0, h * w - 1), p -> slice(px, p * c + 1, c)))").alias("f"))
    every = subspace.Saab.fit(cut, variant="v2", use_dc=False)
    low = np.zeros((5, 5), bool)
    low[[1, 2, 2, 2, 3], [2, 1, 2, 3, 2]] = True
    for least in (0.5, 0.8, 0.95):
        want = []
        for k, v in enumerate(every.kernels):
            s = np.abs(np.fft.fftshift(np.fft.fft2(v.reshape(5, 5))))
            if 1 - s[low].sum() / s.sum() > least:
                want.append(k)
        made = subspace.Saab.fit(cut, variant="v2", use_dc=False, high_frequency=least)
        assert np.allclose(made.kernels, every.kernels[want]) and np.allclose(made.energy, every.energy[want] / max(every.energy[want].sum(), 1e-300))
        assert len(subspace.Saab.fit(cut, high_frequency=least).kernels) >= 1
    with pytest.raises(ValueError):
        subspace.frequency_choice(np.eye(3), 0.5)


def test_two_stages_of_saab(spark):
    x, rows = pictures(spark)
    made = subspace.MultiSaab.fit(rows, (3, 2), energy_percent=0.9)
    now = [v[:, :, None] for v in x]
    for k, size in enumerate((3, 2)):
        cut = [np.array([[v[i : i + size, j : j + size].ravel() for j in range(v.shape[1] - size + 1)] for i in range(v.shape[0] - size + 1)]) for v in now]
        p = np.concatenate([c.reshape(-1, c.shape[-1]) for c in cut])
        rest = p - p.mean(axis=1, keepdims=True)
        values, vectors = np.linalg.eigh(np.cov(rest[rest.std(axis=1) > 0].T))
        n = int((np.cumsum(values[::-1]) / values.sum() < 0.9).sum()) + 1
        assert len(made.kernels[k]) == n + 1 and np.allclose(made.energy[k], values[::-1][:n]) and np.isclose(made.total[k], values.sum())
        assert np.allclose(np.abs((made.kernels[k][1:] * vectors.T[::-1][:n]).sum(axis=1)), 1)
        assert np.isclose(np.var(p @ made.kernels[k][0]), 1)
        assert np.isclose(made.bias[k], np.linalg.norm(p, axis=1).max() if k else 0.0)
        out = []
        for c in cut:
            y = (c + np.sqrt(p.shape[1]) * made.bias[k]) @ made.kernels[k].T
            y[:, :, 0] -= made.bias[k]
            out.append(np.array([[y[i : i + 2, j : j + 2].reshape(-1, y.shape[-1]).max(axis=0) if i + 2 <= y.shape[0] and j + 2 <= y.shape[1] else np.maximum(0, y[i : i + 2, j : j + 2].reshape(-1, y.shape[-1]).max(axis=0)) for j in range(0, y.shape[1], 2)] for i in range(0, y.shape[0], 2)]))
        now = out
    got = {r.image_id: np.reshape(r.px, (r.h, r.w, r.c)) for r in made.transform(rows).collect()}
    assert all(np.allclose(got[i], v) for i, v in enumerate(now))
    few = subspace.MultiSaab.fit(rows, (3,), counts=(4,), per_class=3)
    assert few.kernels[0].shape == (5, 9)
    assert subspace.MultiSaab.fit(rows.where("false"), (3, 2)).kernels == []


def test_all_hops_in_one_pass(spark):
    _, rows = pictures(spark)
    hops = (HopSpec(window=2, stride=2, border=None), HopSpec(window=2, stride=2, border=None))
    tree = subspace.fit_tree(rows, hops, 0.02)
    made = subspace.transform_tree(rows, tree, 0.001)
    for k, hop in enumerate(made):
        keep = np.flatnonzero(tree.energy[k] >= 0.001)
        want = {r.image_id: tree.responses(grid.as_image(r.px, r.h, r.w, r.c))[k][:, :, keep] for r in rows.collect()}
        assert all(np.allclose(np.reshape(r.px, (r.h, r.w, r.c)), want[r.image_id]) for r in hop.collect()) and hop.count() == len(want)


# ---- clusters, orders, joins --------------------------------------------------------------------


def test_minibatch_kmeans_costs_little_more(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.4, (300, 3)) for c in rng.uniform(-5, 5, (6, 3))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>").repartition(3)
    placed, centres = cluster.minibatch_kmeans(rows, 6, batch=50)
    _, _, full = cluster.kmeans(rows, 6)
    cost = placed.agg(F.sum(F.col("distance") ** 2)).first()[0]
    best = min(full, cluster.lloyd(rows, centres, max_iter=50)[1])
    assert len(centres) == 6 and placed.count() == len(x) and cost <= 1.05 * best
    odd = spark.createDataFrame([(1, None), (2, [1.0, None]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "id long, f array<double>")
    assert cluster.minibatch_kmeans(odd, 3)[1] == [[1.0, 2.0]] and cluster.minibatch_kmeans(odd, 3)[0].count() == 2
    assert cluster.minibatch_kmeans(odd.where("false"), 3)[0].count() == 0 and cluster.kmeans(odd.where("false"), 2)[1] == []
    assert cluster.kmeans(odd, 1)[1] == [[1.0, 2.0]]


def test_global_ranks(spark, many_tasks):
    rows = spark.range(3_000).select("id", F.when(F.col("id") % 3 < 2, "hot").when(F.col("id") % 30 == 2, None).otherwise((F.col("id") % 7).cast("string")).alias("g"), F.xxhash64("id").alias("h"))
    got = ranks.ranked(rows, "h", by=("g",), size="n").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append(r)
    assert sum(map(len, by.values())) == 3_000
    for own in by.values():
        own.sort(key=lambda r: r.h)
        assert [r["rank"] for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
    assert [r.before for r in ranks.running_before(spark.range(1_000), "id", "id", "before").orderBy("id").collect()] == [sum(range(k)) for k in range(1_000)]
    assert ranks.ranked(rows.where("false"), "h").count() == 0


def test_areas_folds_and_labels(spark, many_tasks):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), np.round(rng.normal(size=400), 1)
    rows = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, label long, score double")
    pairs = s[y == 1][:, None] - s[y == 0]
    assert np.isclose(metrics.roc_auc(rows).first()[0], (pairs > 0).mean() + (pairs == 0).mean() / 2)
    assert metrics.roc_auc(rows.where("label = 1")).first()[0] is None and metrics.roc_auc(rows.where("false")).first()[0] is None
    folds = {(r.label, r.fold): r.n for r in sampling.stratified_folds(rows, "id", 7).groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for c in (0, 1):
        sizes = [folds[c, k] for k in range(7)]
        assert sum(sizes) == (y == c).sum() and sizes == sorted(sizes, reverse=True) and sizes[0] - sizes[-1] <= 1
    assert sampling.stratified_folds(rows.limit(3), "id", 7).where("fold between 0 and 6").count() == 3
    assert sorted(r.id for r in sampling.between(rows, 10, 25, "id").collect()) == list(range(10, 25))
    assert sampling.between(rows.where("false"), 0, 5, "id").count() == 0
    names = spark.createDataFrame([(v,) for v in "dbcabd"] + [(None,)], "label string")
    assert {(r.label, r.dense) for r in learn.dense_labels(names).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_centroids_in_blocks(spark, many_tasks):
    rng = np.random.default_rng(0)
    x, c = rng.normal(size=(50, 3)), np.round(rng.normal(size=(23, 3)), 1)
    c[7] = c[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, f array<double>")
    table = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(c)], "centroid long, class long, c array<double>")
    one = {r.id: (r.centroid, r.distance) for r in joins.nearest_centroid(rows, table.drop("class")).collect()}
    assert one == {r.id: (r.centroid, r.distance) for r in joins.nearest_centroid(rows, table.drop("class"), most=5).collect()}
    assert [one[i][0] for i in range(50)] == ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1).tolist()
    votes = lambda **s: sorted((r.id, r["class"], round(r.share, 12)) for r in joins.centroid_vote(rows, table, 6, **s).collect())
    assert votes() == votes(most=4)


def test_sweep_in_arrays_equals_that_over_rows(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, i, j, float(np.round(rng.random(), 1)), int(rng.integers(0, 2))) for k in range(5) for i in range(3) for j in range(4)], "image_id long, i int, j int, rho double, d int")
    whole = rows.groupBy("image_id").agg(F.collect_list(F.struct("rho", "i", "j", "d")).alias("costs"))
    key = lambda t: sorted((r.image_id, r.n, round(r.precision, 9), round(r.recall, 9)) for r in t.collect())
    assert key(topk.region_sweep(rows, [1, 4, 12])) == key(topk.region_sweep_in_images(whole, [1, 4, 12, 99]))


def test_linear_models_of_clusters(spark):
    rng = np.random.default_rng(0)
    x, k = rng.normal(size=(200, 3)), rng.integers(0, 4, 200)
    y = x @ np.array([1.0, -2.0, 0.5]) * (k + 1) + k
    rows = spark.createDataFrame([(int(c), v.tolist(), float(t)) for c, v, t in zip(k, x, y)] + [(1, None, 1.0), (1, [None, 1.0, 1.0], 1.0), (1, [1.0, 1.0, 1.0], None)], "cluster long, f array<double>, y double").repartition(3)
    got = {r.cluster: (r.n, r.w) for r in cluster.per_cluster_linear(rows).collect()}
    assert got.keys() == {0, 1, 2, 3}
    for c in range(4):
        assert got[c][0] == (k == c).sum() and np.allclose(got[c][1], [c + 1, -2 * (c + 1), 0.5 * (c + 1), c])
    assert cluster.per_cluster_linear(rows.where("false")).count() == 0


def test_both_models_without_a_join(spark):
    _, _, rows = labelled(spark, 20)
    times = lambda k: lambda d: d.withColumn("f", F.transform("f", lambda v: v * k))
    out = learn.cross_apply(rows.select("id", "f"), rows.select("id", "f"), times(2), times(3))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.f for r in rows.collect()}
    assert all(np.allclose(r.f, [2 * v for v in want[r.id]] + [3 * v for v in want[r.id]]) for r in out.collect()) and out.count() == 40


# ---- store --------------------------------------------------------------------------------------


def fitted(spark):
    _, _, rows = labelled(spark, 120)
    _, seen = pictures(spark)
    placed, tree = trees.grow(rows, 4, 3, "error", 10, scale=True)
    leafs = trees.LeafModels.fit(placed, {s["node"]: s["n"] for s in tree.leaves}, Forest(3, 3, 2), 4, classes=3, y="label")
    hops = (HopSpec(window=2, stride=2, border=None), HopSpec(window=2, stride=2, border=None))
    binary = rows.withColumn("label", F.col("label") % 2)
    return {
        "pca": (subspace.PCA.fit(rows), lambda m: m.transform(rows)),
        "saab": (subspace.Saab.fit(rows), lambda m: m.transform(rows)),
        "residual": (subspace.ResidualPCA.fit(rows, 0.5), lambda m: m.transform(rows)),
        "tree": (subspace.fit_tree(seen, hops, 0.02), lambda m: subspace.transform_tree(seen, m)[-1]),
        "pixelhop": (subspace.PixelHop.fit(seen, hops, 0.02, 0.001), lambda m: m.transform(seen)[-1]),
        "stages": (subspace.MultiSaab.fit(seen, (3, 2), counts=(3, 3)), lambda m: m.transform(seen)),
        "least_squares": (learn.LeastSquares.fit(rows.withColumn("y", F.array(F.col("label").cast("double")))), lambda m: m.predict(rows)),
        "lag": (learn.LabelAssisted.fit(rows, 3, 1), lambda m: m.transform(rows)),
        "lag_unit": (lag_unit.LagUnit.fit(rows, 4, 3, 1, threshold=1.0, rounds=1, least=5), lambda m: m.transform(rows)),
        "svc": (learn.RadialSVC.fit(binary, 4, 0.5, landmarks=30), lambda m: m(rows)),
        "kmeans_tree": (tree, lambda m: m.descend(rows)),
        "leaf_models": (leafs, lambda m: m.predict(tree.nearest(rows))),
        "forest": (learn.forest(binary, trees=3, depth=3), lambda m: m(binary)),
        "logistic": (learn.logistic(binary), lambda m: m(binary)),
        "boosted": (learn.boosted(binary, maxIter=2), lambda m: m(binary)),
    }


def test_store(spark, tmp_path):
    """Every learner transforms alike after it was saved and loaded."""
    for name, (model, use) in fitted(spark).items():
        path = f"file://{tmp_path}/{name}"
        assert models.save(spark, model, path) == 1
        again = models.load(spark, path)
        assert type(again) is type(model)
        a, b = (sorted(map(str, use(m).collect())) for m in (model, again))
        assert a == b and a, name


def test_store_versions(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert models.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        models.load(spark, path)
    for k in (1, 2, 3):
        assert models.save(spark, subspace.PCA(np.eye(2) * k, np.ones(2), np.zeros(2)), path) == k
    assert models.load(spark, path).kernels[0, 0] == 3 and models.load(spark, path, 2).kernels[0, 0] == 2 and models.versions(spark, path) == [1, 2, 3]
    (tmp_path / "m" / ".new-interrupted").mkdir()
    assert models.versions(spark, path) == [1, 2, 3]
    with pytest.raises(FileNotFoundError):
        models.load(spark, path, 9)
    with pytest.raises(TypeError):
        models.save(spark, {"f": open}, path)
    (tmp_path / "m" / "v3" / "description" / "x.txt").write_text('{"$class": "os:system", "fields": {}}')
    with pytest.raises(ValueError):
        models._Reader(spark, f"{path}/v3").decode({"$class": "os:system", "fields": {}})


@pytest.mark.parametrize("name", ["saab_inverse_error", "model_scan"])
def test_ties_that_come_back_are_rounded_as_in_sql(spark, tmp_path, name):
    """Odd multiples of 1/64 are ties of the fifth decimal; products of doubles give a little less or more."""
    import duckdb

    from pixelloom.plans import registry

    rng = np.random.default_rng(1)
    x = np.where(rng.random((60, 64)) < 0.1, (rng.integers(-20, 20, (60, 64)) * 2 + 1) / 64, rng.normal(0, 0.125, (60, 64)))
    spark.createDataFrame([(k, v.tolist(), k % 10) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    made = registry.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(repr(tuple(r)) for r in made.collect()) == sorted(map(repr, want))
