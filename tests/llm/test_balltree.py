import hashlib

import numpy as np
import pytest

from pixelloom.llm import balltree as B
from pixelloom.llm import queries
from tests.compare import same

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def lloyd(ids, x, k, rounds):
    """Plain Lloyd rounds over exact integers."""
    order = sorted(range(len(ids)), key=lambda i: (hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest(), ids[i]))
    c = [list(map(int, x[i])) for i in order[:k]]
    far = lambda p, q: sum((int(a) - int(b)) ** 2 for a, b in zip(p, q))
    for step in range(rounds + 1):
        near = [min((far(p, q), j) for j, q in enumerate(c)) for p in x]
        if step == rounds:
            return near, c
        for j in range(len(c)):
            own = [p for p, n in zip(x, near) if n[1] == j]
            if own:
                c[j] = [sum(map(int, col)) // len(own) for col in zip(*own)]


@pytest.mark.parametrize("spread", [3.0, 0.01])
def test_equals_lloyd(spark, spread):
    """Clusters far apart (whole balls are counted) and a single cloud (leaves decide); many equal vectors and ties."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(scale=0.05, size=(60, 6)) + spread * rng.normal(size=6) for _ in range(12)] + [np.full((90, 6), 0.5)])
    rows = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], SCHEMA).repartition(3)
    vectors = B.whole_vectors(rows, 6, 256.0)
    labels, centroids = B.cluster(vectors, 9, 4, 6)
    near, want = lloyd(list(range(len(x))), np.floor(256 * x).astype(int), 9, 4)
    assert centroids == want
    assert {r["id"]: (r["distance"], r["cluster"]) for r in labels.collect()} == dict(enumerate(near))


def test_tree_assigns_whole_balls():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-9, 9, (400, 4)) + 1000 * k for k in range(5)])
    tree, order = B.Tree.build(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.points == x[order]).all()
    centroids = np.array([[1000 * k] * 4 for k in range(5)])
    visits = list(tree.visit(centroids))
    assert sum(isinstance(who, int) for _, _, who, _ in visits) >= 5 and len(visits) < 30
    assert sum(z - a for a, z, _, _ in visits) == len(x)
    for a, z, who, node in visits:
        assert (np.asarray(who) == ((tree.points[a:z, None] - centroids) ** 2).sum(axis=2).argmin(axis=1)).all()
        if isinstance(who, int):
            assert (tree.sums[node] == tree.points[a:z].sum(axis=0)).all()


def test_large_components_are_exact(spark):
    """Products beyond the exact integers of doubles."""
    x = [[float(1 << 18) + 1 / 256, 0.0], [float(1 << 18), 0.0], [-float(1 << 18), 5.0]]
    labels, centroids = B.cluster(B.whole_vectors(spark.createDataFrame([(i, v, "") for i, v in enumerate(x)], SCHEMA), 2, 256.0), 2, 2, 2)
    near, want = lloyd([0, 1, 2], np.floor(256 * np.array(x)).astype(np.int64), 2, 2)
    assert centroids == want and {r["id"]: (r["distance"], r["cluster"]) for r in labels.collect()} == dict(enumerate(near))


def test_odd_rows(spark):
    """Nulls, other lengths, non-finite and too large components are left out; a null id and repeated rows are vectors."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (None, [3.0, 4.0], None), (2, None, ""), (3, [1.0], ""), (4, [1.0, None], ""), (5, [nan, 1.0], ""), (6, [-inf, 1.0], ""), (7, [1e30, 1.0], ""), (8, [], "")]
    labels, centroids = B.cluster(B.whole_vectors(spark.createDataFrame(rows, SCHEMA), 2, 256.0), 40, 5, 2)
    assert centroids == [[256, 512], [256, 512], [768, 1024]]
    assert sorted((r["id"] or 0, r["cluster"], r["distance"]) for r in labels.collect()) == [(0, 2, 0), (1, 0, 0), (1, 0, 0)]
    report = B.report(labels, centroids).collect()
    assert {r["inertia"] for r in report} == {0} and {r["centroid_sha256"] for r in report} == {hashlib.sha256(t).hexdigest() for t in (b"256,512", b"768,1024")}
    none = B.report(*B.cluster(B.whole_vectors(spark.createDataFrame([], SCHEMA), 2, 256.0), 40, 5, 2))
    assert none.count() == 0 and "centroid_sha256" in none.columns


def test_query(spark, sf_dir):
    same(spark, sf_dir, queries.op12_balltree, queries.oracle_sql()["op12_balltree"])
