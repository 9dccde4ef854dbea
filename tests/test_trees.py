"""Trees and leaf models against plain numpy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.functions.forest import Constant, Forest, Linear, Logistic
from pixelloom.operators import trees as T


def cloud(spark, n=400, d=3, seed=0, partitions=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + 4 * rng.integers(0, 3, size=(n, 1)) * np.array([1, -1, 0.5])[:d]
    y = (x[:, 0] + rng.normal(size=n) > 3).astype(int)
    rows = spark.createDataFrame([(i, v.tolist(), int(c), "clash") for i, (v, c) in enumerate(zip(x, y))], "id long, f array<double>, label long, child string").repartition(partitions)
    return x, y, rows


def two_means(x, steps=5, centres=None):
    """Children by Lloyd steps from both sides of the mean."""
    c = np.array([x.mean(0) - x.std(0), x.mean(0) + x.std(0)]) if centres is None else centres
    cost = np.inf
    for _ in range(steps):
        far = ((x[:, None] - c) ** 2).sum(axis=2)
        near, now = far.argmin(axis=1), far.min(axis=1).sum()
        new = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(len(c))])
        done = np.abs(new - c).max() < 1e-6 or cost - now <= 1e-6 * max(1, now)
        c, cost = new, now
        if done:
            break
    return ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)


def plain_tree(x, y, leaves, cost, least, accept=None):
    """The costliest leaf first, one after the other."""
    def stats(node, own):
        p = y[own].mean()
        return {"node": node, "n": len(own), "sse": x[own].var(0).sum() * len(own), "purity": max(p, 1 - p), "variance": y[own].var(), "entropy": T.entropy(p)}

    every = {"R": np.arange(len(x))}
    current, refused = {"R": stats("R", every["R"])}, set()
    while len(current) < leaves:
        able = [s for s in current.values() if s["n"] >= 2 * least and s["node"] not in refused]
        if not able:
            break
        best = max(able, key=lambda s: (T.COSTS[cost](s), s["node"]))
        side = two_means(x[every[best["node"]]])
        made = [(best["node"] + str(k), every[best["node"]][side == k]) for k in range(2) if (side == k).any()]
        children = [stats(*m) for m in made]
        if len(made) < 2 or accept and not accept(best, children):
            refused.add(best["node"])
            continue
        every |= dict(made)
        del current[best["node"]]
        current |= {s["node"]: s for s in children}
    return {n: set(every[n].tolist()) for n in current}


@pytest.mark.parametrize("cost, leaves, guided", [("spread", 6, False), ("purity", 5, False), ("error", 9, False), ("loss", 7, True), ("variance", 4, False)])
def test_grow_is_best_first(spark, cost, leaves, guided):
    x, y, rows = cloud(spark)
    accept = T.accept_by_loss() if guided else None
    placed, tree = T.grow(rows, 3, leaves, cost, 10, accept=accept)
    want = plain_tree(x, y, leaves, cost, 10, accept)
    got = {r["node"]: set(r["ids"]) for r in placed.groupBy("node").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == want and {s["node"]: s["n"] for s in tree.leaves} == {n: len(i) for n, i in want.items()}
    assert tree.descend(rows).join(placed.select("id", F.col("node").alias("same")), "id").where("node <> same").count() == 0


def test_passes_grow_with_levels(spark, monkeypatch):
    _, _, rows = cloud(spark, 600)
    calls, real = [], T.sums
    monkeypatch.setattr(T, "sums", lambda *a, **k: calls.append(1) or real(*a, **k))
    counts = []
    for leaves in (8, 16):
        calls.clear()
        _, tree = T.grow(rows, 3, leaves, "error", 2)
        assert len(tree.leaves) == leaves
        counts.append(len(calls))
        assert len(calls) <= 6 * max(len(n) for n in tree.nodes) + 1
    assert counts[1] <= counts[0] + 12


def test_blocks_of_centres(spark, monkeypatch):
    """Centres and models that don't fit into one message go out in several passes."""
    x, y, rows = cloud(spark)
    want, tree = T.grow(rows, 3, 6, "error", 10)
    models = T.LeafModels.fit(want, {s["node"]: s["n"] for s in tree.leaves}, Linear(), 3, y="label")
    whole = {r["id"]: r["prediction"][0] for r in models.predict(want).collect()}
    monkeypatch.setattr(T, "SENT_BYTES", 150)
    got, _ = T.grow(rows, 3, 6, "error", 10)
    assert {r["id"]: r["node"] for r in got.collect()} == {r["id"]: r["node"] for r in want.collect()}
    assert {r["id"]: r["prediction"][0] for r in models.predict(want).collect()} == whole


def test_scaled_tree(spark):
    x, y, rows = cloud(spark)
    stretched = rows.withColumn("f", F.transform("f", lambda v, i: v * F.pow(F.lit(10.0), i) + i))
    placed, tree = T.grow(stretched, 3, 4, "error", 10, scale=True)
    z = (x - x.mean(0)) / x.std(0)
    got = {r["node"]: set(r["ids"]) for r in placed.groupBy("node").agg(F.collect_list("id").alias("ids")).collect()}
    assert got == plain_tree(z, y, 4, "error", 10)
    assert tree.descend(stretched).join(placed.select("id", F.col("node").alias("same")), "id").where("node = same").count() == len(x)


def test_full_tree(spark):
    """Every level by plain k-means from the first rows of the order."""
    x, y, rows = cloud(spark)
    placed, tree = T.grow_full(rows, 3, 3, 2, order=F.lpad(F.col("id").cast("string"), 5, "0"))
    want = {"R": np.arange(len(x))}
    for _ in range(2):
        want = {n + str(k): own[side == k] for n, own in want.items() for side in [two_means(x[own], 10, x[own[:3]])] for k in range(3)}
    assert {r["node"]: set(r["ids"]) for r in placed.groupBy("node").agg(F.collect_list("id").alias("ids")).collect()} == {n: set(i.tolist()) for n, i in want.items() if len(i)}
    _, stopped = T.grow_full(rows, 3, 3, 2, stop=lambda s: s["n"] < len(x))
    assert max(len(n) for n in stopped.nodes) == 2


def test_growing_subset(spark):
    """A node is fitted on the first groups that hold enough rows; all rows are dealt."""
    x, _, rows = cloud(spark)
    group = np.arange(len(x)) % 8
    placed, tree = T.grow_until(rows.withColumn("g", (F.col("id") % 8).cast("int")), 3, 1.0, 30, measure="distance", group="g", enough=90)

    def plain(node, own, used):
        while (group[own] < used).sum() < min(90, len(own)):
            used += 1
        fitted = own[group[own] < used]
        out = {node: (len(own), len(fitted), used)}
        if len(own) < 60 or np.sqrt(((x[own] - x[own].mean(0)) ** 2).sum(1)).mean() <= 1.0:
            return out
        c = np.array([x[fitted].mean(0) - x[fitted].std(0), x[fitted].mean(0) + x[fitted].std(0)])
        cost = np.inf
        for _ in range(5):
            far = ((x[fitted][:, None] - c) ** 2).sum(axis=2)
            near, now = far.argmin(axis=1), far.min(axis=1).sum()
            new = np.array([x[fitted][near == k].mean(0) for k in range(2)])
            done = np.abs(new - c).max() < 1e-6 or cost - now <= 1e-6 * max(1, now)
            c, cost = new, now
            if done:
                break
        side = ((x[own][:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(2):
            out |= plain(node + str(k), own[side == k], used)
        return out

    assert {n: (s["n"], s["used"], s["used_groups"]) for n, s in tree.nodes.items()} == plain("R", np.arange(len(x)), 1)
    assert len({s["used_groups"] for s in tree.nodes.values()}) > 1 and placed.count() == len(x)


@pytest.mark.parametrize("learner, classes", [(Forest(5, 4, 2), None), (Forest(5, 4, 2, balanced=True), 2), (Linear(), None), (Logistic(), 2), (Constant(), None)])
def test_leaf_models_are_those_of_each_leaf_alone(spark, learner, classes):
    x, y, rows = cloud(spark)
    placed, tree = T.grow(rows, 3, 4, "error", 10)
    sample = 60
    models = T.LeafModels.fit(placed, {s["node"]: s["n"] for s in tree.leaves}, learner, 3, classes, sample, y="label")
    got = {r["id"]: r["prediction"] for r in models.predict(tree.nearest(rows)).collect()}
    nearest = {r["id"]: r["node"] for r in tree.nearest(rows).collect()}
    centroids = {s["node"]: np.array(s["centroid"]) for s in tree.leaves}
    assert all(np.isclose(((x[i] - centroids[n]) ** 2).sum(), min(((x[i] - c) ** 2).sum() for c in centroids.values())) for i, n in nearest.items())
    order = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64(F.lit(0), "id").alias("h")).collect()}
    leaf = {r["id"]: r["node"] for r in placed.collect()}
    for node in centroids:
        own = sorted((i for i, n in leaf.items() if n == node), key=lambda i: (order[i], i))[:sample]
        target = (y[own, None] == np.arange(classes)).astype(float) if classes else y[own, None].astype(float)
        params = learner.fit(x[own], target, np.ones(len(own)), zlib.crc32(node.encode()))
        for i in [i for i, n in nearest.items() if n == node]:
            assert np.allclose(got[i], learner.predict(params, x[i : i + 1])[0])


def test_a_hot_leaf_is_sampled_before_it_is_grouped(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") < 19_000, "hot").otherwise(F.concat(F.lit("n"), (F.col("id") % 50).cast("string"))).alias("node"), F.array(F.col("id").cast("double")).alias("f"), F.lit(1.0).alias("y"))
    sizes = {r[0]: r[1] for r in rows.groupBy("node").count().collect()}
    few = T.sample_leaves(rows, sizes, 200)
    counts = {r[0]: r[1] for r in few.groupBy("node").count().collect()}
    assert counts == {n: min(c, 200) for n, c in sizes.items()}
    lowest = sorted(rows.where("node = 'hot'").select(F.xxhash64(F.lit(0), "id")).toPandas().iloc[:, 0])[:200]
    assert sorted(r["_h"] for r in few.where("node = 'hot'").collect()) == lowest
    other = T.sample_leaves(rows.repartition(7), sizes, 200)
    assert {r["id"] for r in few.collect()} == {r["id"] for r in other.collect()}


def test_held_out_loss_refuses_useless_splits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2))
    noise = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, rng.integers(0, 2, 300)))], "id long, f array<double>, label long")
    price = T.held_out_loss(Forest(10, 3, 2), 2)
    _, tree = T.grow(noise, 2, 4, "error", 20, price=price, accept=T.accept_by_loss(0.05, "loss"))
    assert list(tree.nodes) == ["R"] and tree.nodes["R"]["loss"] > 0.5
    far = np.where(np.arange(300)[:, None] < 150, -5.0, 5.0) + x
    label = (np.where(far[:, 0] < 0, far[:, 1] > -5, far[:, 1] < 5)).astype(int)
    xor = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(far, label))], "id long, f array<double>, label long")
    _, tree = T.grow(xor, 2, 2, "error", 20, price=T.held_out_loss(Linear(), None), accept=T.accept_by_loss(0.0, "loss"))
    assert len(tree.leaves) == 2


def test_odd_rows(spark):
    """Nulls, other lengths, non-finite components, null labels, repeated rows, empty tables."""
    nan = float("nan")
    good = [(i, [float(i % 2), 1.0], i % 2) for i in range(20)]
    rows = spark.createDataFrame([*good, (90, None, 1), (91, [1.0], 1), (92, [1.0, None], 1), (93, [nan, 1.0], 0), (94, [0.0, 1.0], None), (None, None, None)], "id long, f array<double>, label long")
    placed, tree = T.grow(rows, 2, 4, "error", 2)
    assert {s["node"]: s["n"] for s in tree.leaves} == {"R0": 11, "R1": 10} and placed.count() == 21  # equal rows can't be split
    models = T.LeafModels.fit(placed, {"R0": 11, "R1": 10}, Constant(), 2, y="label")
    assert {r["node"]: r["used"] for r in models.table.collect()} == {"R0": 10, "R1": 10}
    assert tree.nearest(rows).count() == 21
    none = rows.where("false")
    placed, tree = T.grow(none, 2, 4, "error", 2)
    assert placed.count() == 0 and tree.nodes == {} and tree.nearest(none).count() == 0 and tree.descend(none).count() == 0
    placed, tree = T.grow_full(none, 2, 3, 2)
    assert placed.count() == 0 and tree.leaves == []
    empty = T.LeafModels.fit(placed, {}, Forest(), 2, y="label")
    assert empty.table.count() == 0 and empty.predict(placed).count() == 0
    one = T.LeafModels.fit(T.grow(rows.limit(1), 2, 4)[0], {"R": 1}, Forest(), 2, y="label")
    assert one.table.count() == 1


def test_forest_learns_what_a_line_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    one_hot = np.column_stack([1 - y, y])
    forest = Forest(30, 8, 2)
    p = forest.predict(forest.fit(x[:600], one_hot[:600], np.ones(600), 0), x[600:])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y[600:]).mean() > 0.9
    deep = Forest(1, 30, 1)
    assert np.allclose(deep.predict(deep.fit(x, y[:, None], np.ones(800), 0), x)[:, 0], y)
    stump = Forest(1, 1, 1)
    params = stump.fit(np.array([[0.0], [1.0], [2.0], [10.0]]), np.array([[0.0], [0.0], [0.0], [9.0]]), np.ones(4), 0)
    assert params[1][0] == 6.0
