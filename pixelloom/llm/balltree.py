"""Centroid clustering of integer vectors with ball trees.

Every task builds metric trees over its own vectors, at most TREE_ROWS to a tree, and writes them once. A node is a ball: centre,
radius, count and integer sum of its vectors. A round sends the centroids down the trees: by the triangle inequality a
centroid whose distance to a ball's centre exceeds that of the nearest one by more than two radii is nobody's nearest in
that ball; where a single centroid is left the whole ball is counted for it, else its children are asked, at last the
vectors of a leaf, exactly. What leaves a task is a count and a sum per centroid; the driver holds the centroids only.

Defined cases: vectors with another number of components, or null or non-finite ones, are left out, and so are those with a
component beyond 2^27 once scaled, whose squared distances no long can hold; ties go to the smaller centroid; a centroid
without vectors stays; fewer vectors than centroids make fewer centroids; an empty table gives no rows; repeated rows
are vectors of their own; a null id comes after all others when the first centroids are chosen. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import few_rows, materialize

TREE_ROWS, LEAF_ROWS = 16_384, 48
LIMIT = float(1 << 27)
#: Below it, squared distances of up to a few thousand components are exact in doubles.
EXACT = 1 << 20
TREES = "ids array<long>, points binary, starts binary, ends binary, rights binary, radii binary, centres binary, sums binary"


def whole_vectors(rows: DataFrame, size: int, scale: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows whose vectors have `size` finite components, each as the integer floor(scale * x)."""
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    good = (F.size(vector) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LIMIT))
    return rows.where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with smallest SHA-256 of `seed` and their id."""
    order = [F.col("id").isNull(), F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256), "id", "v"]
    return [list(r[0]) for r in vectors.orderBy(*order).limit(k).select("v").collect()]


# ---- trees ------------------------------------------------------------------------------------------


class Tree:
    """Nodes in preorder: the left child of a node follows it, its right child is at rights (0: a leaf)."""

    def __init__(self, points: np.ndarray, starts, ends, rights, radii, centres, sums):
        self.points, self.starts, self.ends, self.rights, self.radii, self.centres, self.sums = points, starts, ends, rights, radii, centres, sums
        self.exact = not len(points) or int(np.abs(points).max()) < EXACT

    @staticmethod
    def build(points: np.ndarray, leaf: int = LEAF_ROWS) -> tuple[Tree, np.ndarray]:
        """(tree over points in its own order, that order)."""
        order = np.arange(len(points))
        nodes: list[list] = []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            if parent >= 0:
                nodes[parent][2] = len(nodes)
            x = points[order[a:b]].astype(float)
            total = points[order[a:b]].sum(axis=0, dtype=np.int64)
            centre = total / (b - a)
            far = ((x - centre) ** 2).sum(axis=1)
            nodes.append([a, b, 0, float(np.sqrt(far.max())), centre, total])
            if b - a <= leaf or far.max() == 0:
                continue
            one = x[far.argmax()]
            other = x[((x - one) ** 2).sum(axis=1).argmax()]
            side = (x - (one + other) / 2) @ (other - one) > 0
            if side.all() or not side.any():
                side = np.arange(b - a) >= (b - a) // 2
            order[a:b] = np.concatenate([order[a:b][~side], order[a:b][side]])
            cut = a + int((~side).sum())
            todo.append((cut, b, len(nodes) - 1))  # taken last, when the left side is done
            todo.append((a, cut, -1))
        cols = list(zip(*nodes, strict=True))
        return Tree(points[order], *(np.array(c, np.int64) for c in cols[:3]), np.array(cols[3]), np.array(cols[4]), np.array(cols[5], np.int64)), order

    def visit(self, centroids: np.ndarray) -> Iterator[tuple[int, int, int | np.ndarray, int]]:
        """(start, end, centroid of the whole ball or of each vector, node)."""
        real = centroids.astype(float)
        exact = self.exact and int(np.abs(centroids).max()) < EXACT
        todo = [(0, np.arange(len(centroids)))]
        while todo:
            node, near = todo.pop()
            a, b, r = int(self.starts[node]), int(self.ends[node]), self.radii[node]
            d = np.sqrt(((real[near] - self.centres[node]) ** 2).sum(axis=1))
            least = d.min()
            near = near[d - r <= least + r + 1e-9 * (1 + least + r)]
            if len(near) == 1:
                yield a, b, int(near[0]), node
            elif self.rights[node]:
                todo += [(int(self.rights[node]), near), (node + 1, near)]
            else:
                yield a, b, near[squares(self.points[a:b], centroids[near], exact).argmin(axis=1)], node


def squares(points: np.ndarray, centroids: np.ndarray, exact: bool) -> np.ndarray:
    """Squared distances, exact: in doubles if all products are, else in integers."""
    kind = np.float64 if exact else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    if exact:
        return (p * p).sum(axis=1)[:, None] - 2 * p @ c.T + (c * c).sum(axis=1)
    return np.stack([((p - x) ** 2).sum(axis=1) for x in c], axis=1)


_TREES = pa.schema([("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("points", "starts", "ends", "rights", "radii", "centres", "sums")]])


def _pack(ids: list, points: np.ndarray) -> pa.RecordBatch:
    tree, order = Tree.build(points)
    cols = [tree.points.astype(np.int32), tree.starts, tree.ends, tree.rights, tree.radii, tree.centres, tree.sums]
    return pa.RecordBatch.from_arrays([pa.array([[ids[k] for k in order.tolist()]], pa.list_(pa.int64())), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], schema=_TREES)


def _unpack(b: pa.RecordBatch, k: int, size: int) -> Tree:
    kinds = (np.int32, np.int64, np.int64, np.int64, np.float64, np.float64, np.int64)
    points, starts, ends, rights, radii, centres, sums = (np.frombuffer(b.column(n + 1)[k].as_buffer(), t) for n, t in enumerate(kinds))
    return Tree(points.reshape(-1, size), starts, ends, rights, radii, centres.reshape(-1, size), sums.reshape(-1, size))


def plant(vectors: DataFrame, size: int) -> DataFrame:
    """Materialized trees over the vectors of each task, one row a tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, n = [], [], 0
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            at = 0
            while at < len(x):
                take = min(len(x) - at, TREE_ROWS - n)
                ids += b.column(0).slice(at, take).to_pylist()
                parts.append(x[at : at + take].astype(np.int32))
                at, n = at + take, n + take
                if n == TREE_ROWS:
                    yield _pack(ids, np.concatenate(parts))
                    ids, parts, n = [], [], 0
        if n:
            yield _pack(ids, np.concatenate(parts))

    return materialize(vectors.select("id", "v").mapInArrow(run, TREES), "balltree")


# ---- rounds -----------------------------------------------------------------------------------------


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of the vectors nearest to each centroid; at most a row per centroid and task is added up."""
    k, size = centroids.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                tree = _unpack(b, i, size)
                for a, z, who, node in tree.visit(centroids):
                    if isinstance(who, int):
                        counts[who] += z - a
                        sums[who] += tree.sums[node]
                    else:
                        np.add.at(sums, who, tree.points[a:z])
                        counts += np.bincount(who, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own], pa.int64()), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>")
    whole = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(size)]
    return {r[0]: (int(r[1]), [int(x) for x in r[2:]]) for r in parts.groupBy("cluster").agg(F.sum("n"), *whole).collect()}


def label(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector; distance: squared."""
    size = centroids.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tree = _unpack(b, i, size)
                who = np.zeros(len(tree.points), np.int32)
                for a, z, c, _ in tree.visit(centroids):
                    who[a:z] = c
                far = ((tree.points.astype(np.int64) - centroids[who]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(who, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int, rounds: int, size: int, seed: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """(materialized rows (id, cluster, distance), final centroids) after `rounds` moves of the centroids to the floor of their vectors' mean."""
    spark = vectors.sparkSession
    starts = first_centroids(vectors, k, seed)
    if not starts:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    with few_rows(spark, 4_000):
        trees = plant(vectors, size)
    centroids = np.array(starts, np.int64)
    with few_rows(spark, 1):  # a tree at a time
        for _ in range(rounds):
            moved = centroids.copy()
            for c, (n, total) in totals(trees, centroids).items():
                moved[c] = [x // n for x in total]
            if (moved == centroids).all():
                break
            centroids = moved
        return materialize(label(trees, centroids), "balltree-labels"), centroids.tolist()


def report(labels: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """labels with the squared distances summed over the cluster and over all (null where no long holds them) and the digest of the
    centroid's components. The table joined has a row per centroid."""
    sums = {r[0]: int(r[1]) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    every = fits(sum(sums.values()))
    table = [(c, fits(s), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    small = labels.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(small), "cluster")
