import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pixelloom.llm import lattice


def test_e8():
    v = lattice.minimal_vectors()
    assert len(v) == 240 and len({tuple(x) for x in v}) == 240 and ((v / 2) ** 2).sum(axis=1).tolist() == [2.0] * 240
    x = np.random.default_rng(0).normal(size=(300, 8)) * 2
    near = lattice.e8(x) / 2
    d = ((x - near) ** 2).sum(axis=1)
    assert (d <= 1 + 1e-9).all()  # covering radius
    assert all((d <= ((x - near - s / 2) ** 2).sum(axis=1) + 1e-9).all() for s in v)


def brute(rows, cosine=0.95):
    ids = [r[0] for r in rows]
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = [[] for _ in rows]
    for a, b in itertools.combinations(good, 2):
        x, y = (v / np.abs(v).max() for v in (np.array(rows[a][1], float), np.array(rows[b][1], float)))
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
            links[a].append(b)
            links[b].append(a)
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(rows))]
    low = [min((ids[j] for j in range(len(rows)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(rows))]
    return sorted(((ids[i], len(links[i]), low[i], ids[i] == low[i]) for i in range(len(rows))), key=repr)


def rows_of(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        c = rng.normal(size=16)
        rows += [(c + rng.normal(size=16) * 0.08).tolist() for _ in range(g)]
    rows += [rng.normal(size=16).tolist() for _ in range(150)] + [rows[5], rows[5], [2 * x for x in rows[5]]]
    rows += [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8, [1.0] * 8, [1.0] * 4, [1e-200] * 8, [1e200] * 8]
    order = rng.permutation(len(rows))
    return [(int(i), rows[k]) for i, k in enumerate(order)] + [(None, rows[3]), (0, rows[3])]


def result(spark, rows, **settings):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, node long, mult long").repartition(3)
    return sorted(map(tuple, lattice.near_duplicates(table, **settings).collect()), key=repr)


def test_recall_and_no_false_links(spark):
    rows = rows_of()
    got, want = result(spark, rows), brute(rows)
    assert len(got) == len(want)
    a, b = {}, {}
    for r in want:
        b[r[0]] = b.get(r[0], 0) + r[1]
    for r in got:
        a[r[0]] = a.get(r[0], 0) + r[1]
    assert all(a[k] <= b[k] for k in a) and sum(a.values()) >= 0.9 * sum(b.values())
    assert result(spark, rows, block=3) == got  # blocks of a cell change nothing


def test_recall_of_the_test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").where("vec_id < 1200")
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.95).sum()) - len(x)
    found = lattice.near_duplicates(table).agg(F.sum("n_links")).first()[0]
    assert 0.9 * true <= found <= true


def test_no_vectors(spark):
    assert result(spark, rows_of()[:3] * 0 + [(1, [1.0, 2.0])]) == [(1, 0, 1, True)]
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lattice.near_duplicates(table).count() == 0


def test_tables_follow_from_the_recall_asked_for():
    """No cap: the simulated chance of a pair at the threshold is at least 0.9 whatever the number of vectors."""
    for n in (10**3, 10**6, 10**9, 10**10, 10**11):
        scale, tables = lattice.plan(n, 0.95)
        met = lattice.chance(scale, 0.95, trials=30_000)
        assert 1 - (1 - met) ** tables >= 0.9


def test_recall_among_many_vectors(spark):
    """100,000 vectors, with 2,000 planted pairs little above the threshold."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(98_000, 32)).astype(np.float32)
    a = x[:2000] / np.linalg.norm(x[:2000], axis=1, keepdims=True)
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = 0.951 + 0.01 * rng.random((2000, 1))
    every = np.concatenate([x, (c * a + np.sqrt(1 - c * c) * side).astype(np.float32)])
    table = spark.createDataFrame(pa.table({"vec_id": np.arange(len(every)), "embedding": pa.array(list(every), pa.list_(pa.float32()))})).repartition(8)
    found = {r.vec_id: r.component_id for r in lattice.near_duplicates(table).where("n_links > 0").collect()}
    assert sum(found.get(98_000 + i) == i for i in range(2000)) >= 0.95 * 2000
