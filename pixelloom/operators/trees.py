"""Trees of k-means splits, grown a level at a time, and small models in their leaves.

A level's splits move together: a pass over the rows adds up count, label, distance and offsets of every child of every node that is
being split, so the number of passes is that of the steps and levels, whatever the number of nodes. Splitting the costliest leaf
first needs splits one after the other only in the order in which they are taken: those that may still be taken are made at once,
then the order is followed over their figures. Centres travel as blocks of bounded size, a pass each; assignments are
written once a level.

Leaf models: rows of a leaf are sampled by the lowest hashes of their keys, at most `sample` per leaf whatever its size; candidates
are cut by the leaf's count before they are grouped, so a leaf of any size spreads over tasks. Models are rows (node, numbers).

Defined cases: rows whose vector is null, has another number of components, or a null or non-finite one belong to no node and are
left out; null labels are counted in sizes only, and left out by leaf models; an empty table has no nodes; equal rows can't be split;
ties go to the first child and to the later path.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.sources.scratch import dropped, written

#: Most bytes of centres, or of models, that are sent at once.
SENT_BYTES = 1 << 26
#: Names of children: up to 36.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
SUMS = "node string, child int, v array<double>"


def usable(rows: DataFrame, size: int, f: str = "f") -> DataFrame:
    """Rows whose vectors have `size` finite components."""
    good = (F.size(f) == size) & F.forall(f, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _blocks(plan: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    block, room = {}, SENT_BYTES
    for node, c in plan.items():
        if block and room < c.nbytes:
            yield block
            block, room = {}, SENT_BYTES
        block[node] = c
        room -= c.nbytes
    if block:
        yield block


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)


@dataclass
class Sums:
    """Of the rows of a child: count, labels, distances to its centre, offsets from it and their squares."""

    n: int
    labelled: int
    label: float
    label2: float
    sse: float
    distance: float
    offset: np.ndarray
    offset2: np.ndarray
    centre: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.offset / self.n

    @property
    def variance(self) -> np.ndarray:
        return np.maximum(self.offset2 / self.n - (self.offset / self.n) ** 2, 0)


def sums(rows: DataFrame, plan: dict[str, np.ndarray], size: int, f: str = "f", label: str = "label", group: str | None = None, use: dict[str, int] | None = None) -> dict[tuple[str, int], Sums]:
    """Sums of every child of the plan (node -> its children's centres). group, use: only rows whose group is below the node's number."""
    spark, out = rows.sparkSession, {}
    slim = rows.select("node", F.col(f).cast("array<double>").alias("f"), F.col(label).cast("double").alias("y"), (F.col(group) if group else F.lit(0)).cast("int").alias("g"))
    for block in _blocks(plan):
        sent = spark.sparkContext.broadcast((block, {n: use[n] for n in block} if use else None))

        def add(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            plan, use = sent.value
            total: dict[tuple[str, int], np.ndarray] = {}
            for b in batches:
                x, nodes = _matrix(b.column(1), size), b.column(0).dictionary_encode()
                y, g = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
                codes = nodes.indices.to_numpy()
                for code, node in enumerate(nodes.dictionary.to_pylist()):
                    if node not in plan:
                        continue
                    own = np.flatnonzero((codes == code) & (g < use[node]) if use else codes == code)
                    if not len(own):
                        continue
                    near = _nearest(x[own], plan[node])
                    for child in np.unique(near).tolist():
                        at = own[near == child]
                        d, z = x[at] - plan[node][child], y[at]
                        far, z = (d * d).sum(axis=1), z[~np.isnan(z)]
                        v = np.concatenate([[len(at), len(z), z.sum(), (z * z).sum(), far.sum(), np.sqrt(far).sum()], d.sum(axis=0), (d * d).sum(axis=0)])
                        total[node, child] = total.get((node, child), 0) + v
            cols = [[k[0] for k in total], [k[1] for k in total], [v.tolist() for v in total.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.list_(pa.float64())))], names=["node", "child", "v"])

        parts = slim.mapInArrow(add, SUMS).select("node", "child", F.posexplode("v").alias("p", "v"))
        t = parts.groupBy("node", "child", "p").agg(F.sum("v").alias("v")).toPandas()  # bounded by the block
        sent.destroy()
        for (node, child), own in t.groupby(["node", "child"]):
            v = own.sort_values("p")["v"].to_numpy()
            out[node, int(child)] = Sums(int(v[0]), int(v[1]), *map(float, v[2:6]), v[6 : 6 + size], v[6 + size :], block[node][int(child)])
    return out


def entropy(p: float) -> float:
    return float(-sum(q * np.log(max(q, 1e-12)) for q in (p, 1 - p)))


def figures(node: str, s: Sums) -> dict:
    """A node's row: size, spread, label share and its purity, label variance, entropy, mean distance, centroid."""
    p = s.label / s.labelled if s.labelled else 0.0
    v = max(s.label2 / s.labelled - p * p, 0.0) if s.labelled else 0.0
    return {
        "node": node, "n": s.n, "sse": float(s.variance.sum()) * s.n, "mean_label": p, "purity": max(p, 1 - p), "variance": v, "entropy": entropy(min(max(p, 0.0), 1.0)),
        "distance": s.distance / s.n, "deviation": np.sqrt(s.variance).tolist(), "centroid": s.mean.tolist(),
    }


def settle(rows: DataFrame, starts: dict[str, np.ndarray], size: int, steps: int = 10, f: str = "f", label: str = "label", tolerance: float = 1e-6, group: str | None = None, use: dict[str, int] | None = None) -> dict[str, np.ndarray]:
    """k-means inside each node from given starts, all nodes at once; a node stops when its centres or its cost stand still."""
    centres, moving, cost = dict(starts), set(starts), dict.fromkeys(starts, float("inf"))
    for _ in range(steps):
        if not moving:
            break
        found = sums(rows, {n: centres[n] for n in sorted(moving)}, size, f, label, group, use)
        for node in sorted(moving):
            own = {c: found[node, c] for c in range(len(centres[node])) if (node, c) in found}
            new = np.array([own[c].mean if c in own else old for c, old in enumerate(centres[node])])
            now, moved = sum(s.sse for s in own.values()), float(np.abs(new - centres[node]).max())
            if moved < tolerance or cost[node] - now <= tolerance * max(1.0, now):
                moving.discard(node)
            centres[node], cost[node] = new, now
    return centres


def placed(rows: DataFrame, splits: dict[str, np.ndarray], size: int, f: str = "f") -> DataFrame:
    """rows with the child's digit added to the node, where the node is split."""
    for block in _blocks(splits):
        rows = rows.withColumn("node", _child(rows.sparkSession, block)("node", F.col(f)))
    return rows


def _child(spark: SparkSession, block: dict[str, np.ndarray]) -> Callable[..., Column]:
    sent = spark.sparkContext.broadcast(block)

    @F.pandas_udf("string")
    def child(node: pd.Series, x: pd.Series) -> pd.Series:
        plan, out = sent.value, node.copy()
        for name, own in node.groupby(node).groups.items():
            if name in plan:
                near = _nearest(np.stack(x.loc[own].to_list()).astype(float), plan[name])
                out.loc[own] = [name + DIGITS[k] for k in near]
        return out

    return child


COSTS: dict[str, Callable[[dict], float]] = {
    "spread": lambda s: s["sse"] ** 0.5 + 100 * s["purity"] + s["n"] / 1000,
    "purity": lambda s: 1 - s["purity"],
    "variance": lambda s: s["variance"],
    "error": lambda s: s["sse"],
    "loss": lambda s: s["entropy"] * np.log(max(2, s["n"])),
}


@dataclass
class KMeansTree:
    """Nodes by path, and the centres of the children of each node that was split."""

    size: int
    nodes: dict[str, dict] = field(default_factory=dict)
    splits: dict[str, list[list[float]]] = field(default_factory=dict)
    scale: tuple[list[float], list[float]] | None = None

    @property
    def leaves(self) -> list[dict]:
        return [s for n, s in sorted(self.nodes.items()) if n not in self.splits]

    def rows(self) -> list[dict]:
        return [s | {"leaf": n not in self.splits} for n, s in self.nodes.items()]

    def scaled(self, rows: DataFrame, f: str = "f") -> DataFrame:
        """The vectors as the tree was grown on them."""
        if self.scale is None:
            return rows
        at = lambda k: F.array(*[F.lit(float(x)) for x in self.scale[k]])
        return rows.withColumn(f, F.zip_with(F.zip_with(F.col(f), at(0), lambda x, m: x - m), at(1), lambda x, d: x / d))

    def descend(self, rows: DataFrame, f: str = "f") -> DataFrame:
        """Rows with the leaf that the splits lead to, level after level."""
        out = self.scaled(usable(rows, self.size, f), f).withColumn("node", F.lit("R"))
        for depth in range(1, max((len(n) for n in self.nodes), default=1)):
            out = placed(out, {n: np.array(c) for n, c in self.splits.items() if len(n) == depth}, self.size, f)
        return out

    def nearest(self, rows: DataFrame, f: str = "f") -> DataFrame:
        """Rows with the leaf of the nearest centroid."""
        own, size = self.leaves, self.size
        sent = rows.sparkSession.sparkContext.broadcast((np.array([s["centroid"] for s in own]).reshape(-1, size), [s["node"] for s in own]))

        @F.pandas_udf("string")
        def leaf(x: pd.Series) -> pd.Series:
            c, names = sent.value
            z = np.stack(x.to_list()).astype(float) if len(x) else np.zeros((0, size))
            best, far = np.zeros(len(z), int), np.full(len(z), np.inf)
            for k in range(0, len(c), 1024):  # blocks of centroids with a running minimum
                d = (z * z).sum(axis=1)[:, None] - 2 * z @ c[k : k + 1024].T + (c[k : k + 1024] ** 2).sum(axis=1)
                near = d.argmin(axis=1)
                least = d[np.arange(len(z)), near]
                best, far = np.where(least < far, near + k, best), np.minimum(far, least)
            return pd.Series([names[k] for k in best], dtype=object)

        return self.scaled(usable(rows, size, f), f).withColumn("node", leaf(F.col(f)) if own else F.lit(None).cast("string"))


def standardized(rows: DataFrame, size: int, f: str = "f", label: str = "label") -> tuple[list[float], list[float]]:
    """Mean and deviation of the components (1 where a component is constant)."""
    root = sums(rows.withColumn("node", F.lit("R")), {"R": np.zeros((1, size))}, size, f, label).get(("R", 0))
    return (root.mean.tolist(), [d or 1.0 for d in np.sqrt(root.variance).tolist()]) if root else ([0.0] * size, [1.0] * size)


def grow(
    rows: DataFrame, size: int, leaves: int, cost: str | Callable[[dict], float] = "spread", least: int = 2, f: str = "f", label: str = "label",
    accept: Callable[[dict, list[dict]], bool] | None = None, price: Callable[[DataFrame, list[dict]], dict[str, float]] | None = None, steps: int = 5, scale: bool = False, group: str | None = None, enough: float = 0.0,
) -> tuple[DataFrame, KMeansTree]:
    """A binary tree: the costliest leaf with at least 2 x least rows is split until there are so many leaves. (rows with `node`, tree.)

    accept may refuse a split from the figures of parent and children; price adds a loss to the figures of the nodes of a level from
    their rows; scale: on standardized components. group: a column of small numbers; a node is fitted on the rows of groups 0, 1, ... up to
    the first that gives it `enough` rows (figures used and used_groups), and all its rows are dealt."""
    score = COSTS[cost] if isinstance(cost, str) else cost
    tree = KMeansTree(size)
    now = usable(rows, size, f)
    if scale:
        tree.scale = standardized(now, size, f, label)
        now = tree.scaled(now, f)
    now, old = written(now.withColumn("node", F.lit("R")), "tree"), None
    known: dict[str, dict] = {}
    splits: dict[str, np.ndarray] = {}

    def learn(table: DataFrame, centres: dict[str, np.ndarray]) -> None:
        made = [figures(n, s) for (n, _), s in sums(table, centres, size, f, label).items()]
        made = sorted(made, key=lambda s: s["node"])
        if group and made:
            _subset(table, made, known, group, enough)
        losses = price(table, made) if price and made else {}
        known.update({s["node"]: s | ({"loss": losses[s["node"]]} if s["node"] in losses else {}) for s in made})

    learn(now, {"R": np.zeros((1, size))})
    while True:
        current, wanted = _follow(known, splits, leaves, score, least, accept)
        if not wanted:
            break
        use = {n: known[n]["used_groups"] for n in wanted} if group else None
        starts = {n: _both_sides(known[n]) for n in wanted}
        if group:
            part = sums(now, {n: np.array([known[n]["centroid"]]) for n in wanted}, size, f, label, group, use)
            starts = {n: _both_sides(figures(n, part[n, 0])) if (n, 0) in part else starts[n] for n in wanted}
        found = settle(now, starts, size, steps, f, label, group=group, use=use)
        splits |= found
        new = written(placed(now, found, size, f), "tree")
        dropped(now)
        now = new
        learn(now, {n + DIGITS[k]: c[None] for n, cs in found.items() for k, c in enumerate(cs)})
    paths = {n[:k] for n in current for k in range(1, len(n) + 1)}
    tree.nodes = {n: s for n, s in known.items() if n in paths}
    tree.splits = {n: splits[n].tolist() for n in tree.nodes if n not in current}
    return _to_leaves(now, sorted(current)), tree


def _both_sides(s: dict) -> np.ndarray:
    mean, deviation = np.array(s["centroid"]), np.array(s["deviation"])
    return np.array([mean - deviation, mean + deviation])


def _follow(known: dict[str, dict], splits: dict, leaves: int, score: Callable[[dict], float], least: int, accept) -> tuple[set[str], list[str]]:
    """The leaves after all splits whose outcome is known, in order of cost; and those that have to be made to go on."""
    current, able = {n for n in known if n == "R"}, []

    def offer(n: str) -> None:
        if known[n]["n"] >= 2 * least and known[n]["sse"] > 0:
            heapq.heappush(able, (-score(known[n]), [-ord(c) for c in n], n))

    for n in current:
        offer(n)
    while able and len(current) < leaves:
        top = able[0][2]
        if top not in splits:
            return current, [n for *_, n in heapq.nsmallest(leaves - len(current), [a for a in able if a[2] not in splits])]
        heapq.heappop(able)
        children = [known[top + d] for d in DIGITS if top + d in known]
        if len(children) < 2 or accept and not accept(known[top], children):
            continue  # stays a leaf
        current.remove(top)
        for c in children:
            current.add(c["node"])
            offer(c["node"])
    return current, []


def _to_leaves(rows: DataFrame, leaves: list[str]) -> DataFrame:
    """Nodes below a leaf (of splits that weren't taken) back to it."""
    by_length = sorted({len(n) for n in leaves})
    sent = rows.sparkSession.sparkContext.broadcast(set(leaves))

    @F.pandas_udf("string")
    def leaf(node: pd.Series) -> pd.Series:
        return node.map(lambda n: next((n[:k] for k in by_length if n[:k] in sent.value), None))

    return rows.withColumn("node", leaf("node")) if leaves else rows


def _subset(rows: DataFrame, made: list[dict], known: dict[str, dict], group: str, enough: float) -> None:
    """How many groups each new node is fitted on: as many as its parent, or more until it has enough rows."""
    counts: dict[str, dict[int, int]] = {}
    for r in rows.groupBy("node", group).count().collect():  # nodes x groups
        counts.setdefault(r[0], {})[int(r[1])] = int(r[2])
    for s in made:
        own = counts.get(s["node"], {})
        k = known[s["node"][:-1]]["used_groups"] if s["node"][:-1] in known else 1
        used = lambda k, own=own: sum(n for g, n in own.items() if g < k)
        while used(k) < min(enough, s["n"]) and k <= max(own, default=0):
            k += 1
        s["used_groups"], s["used"] = k, used(k)


def grow_until(rows: DataFrame, size: int, most: float, least: int, f: str = "f", measure: str = "sse", **settings) -> tuple[DataFrame, KMeansTree]:
    """Split every leaf whose mean squared distance (measure `distance`: mean distance) exceeds `most` and that holds enough rows."""
    spread = (lambda s: s["distance"]) if measure == "distance" else (lambda s: s["sse"] / max(1, s["n"]))
    return grow(rows, size, 1 << 16, lambda s: spread(s) - most, least, f, accept=lambda parent, _: spread(parent) > most, **settings)


def accept_by_loss(error: float = 0.0, loss: str = "entropy") -> Callable[[dict, list[dict]], bool]:
    """Take a split only if the children's weighted loss is smaller than the parent's by more than `error`."""
    return lambda parent, children: sum(c["n"] * c[loss] for c in children) / parent["n"] < parent[loss] - error


def grow_full(rows: DataFrame, size: int, k: int, depth: int, stop: Callable[[dict], bool] | None = None, f: str = "f", label: str = "label", steps: int = 10, order: Column | None = None) -> tuple[DataFrame, KMeansTree]:
    """A k-ary tree split to a full depth unless `stop` says so of a node's figures. Starts: a node's k rows that come first by `order` (a
    hash of the vector by default)."""
    tree = KMeansTree(size)
    now = written(usable(rows, size, f).withColumn("node", F.lit("R")), "tree")
    tree.nodes = {n: figures(n, s) for (n, _), s in sums(now, {"R": np.zeros((1, size))}, size, f, label).items()}
    level = list(tree.nodes)
    for _ in range(depth):
        wanted = [n for n in level if tree.nodes[n]["n"] >= k and tree.nodes[n]["sse"] > 0 and not (stop and stop(tree.nodes[n]))]
        if not wanted:
            break
        found = settle(now, lowest(now, wanted, k, f, order), size, steps, f, label)
        new = written(placed(now, found, size, f), "tree")
        dropped(now)
        now = new
        made = sums(now, {n + DIGITS[j]: c[None] for n, cs in found.items() for j, c in enumerate(cs)}, size, f, label)
        tree.nodes |= {n: figures(n, s) for (n, _), s in sorted(made.items())}
        tree.splits |= {n: c.tolist() for n, c in found.items()}
        level = [n for n, _ in made]
    return now, tree


def lowest(rows: DataFrame, nodes: list[str], k: int, f: str = "f", order: Column | None = None) -> dict[str, np.ndarray]:
    """Of each node the vectors of the k rows that come first by `order`, rows of equal order once; tasks hand on k of theirs."""
    wanted = set(nodes)
    top = lambda t: t.sort_values(["node", "h"]).drop_duplicates(["node", "h"]).groupby("node").head(k)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for b in batches:
            b = b[b["node"].isin(wanted)]
            best = top(b if best is None else pd.concat([best, b]))
        if best is not None:
            yield best

    hashed = rows.select("node", (F.hex(F.xxhash64(f)) if order is None else order).alias("h"), F.col(f).cast("array<double>").alias("f"))
    kind = "node string, h string, f array<double>"
    few = hashed.mapInPandas(run, kind).groupBy("node").applyInPandas(lambda t: top(t), kind)
    return {n: np.array(own["f"].to_list()) for n, own in few.toPandas().sort_values(["node", "h"]).groupby("node")}


# ---- models in leaves -------------------------------------------------------------------------------


def sample_leaves(rows: DataFrame, sizes: dict[str, int], sample: int, key: str = "id", seed: int = 0) -> DataFrame:
    """At most `sample` rows of each node, those whose keys hash lowest (column `_h`). A node's candidates are cut by its size before they are
    ranked, with room for six deviations, so no ranking sees many more than `sample` rows."""
    spark = rows.sparkSession
    share = [(n, min(1.0, (sample + 6 * math.sqrt(sample) + 6) / max(1, c))) for n, c in sizes.items()]
    bound = F.broadcast(spark.createDataFrame(share, "node string, _share double"))  # a row per leaf of the tree
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    near = hashed.join(bound, "node").where((F.col("_h").cast("double") / float(1 << 63) + 1) / 2 <= F.col("_share")).drop("_share")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("_h", key))).where(F.col("_r") <= sample).drop("_r")


def targets(y: Column, classes: int | None) -> Column:
    """The outputs of a row: its value, or the one-hot code of its class."""
    return F.array(y.cast("double")) if classes is None else F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == y).cast("double"))


def _fitted(learner, t: pd.DataFrame, seed: int) -> list[list[float]]:
    t = t.sort_values(["_h"], kind="stable")
    x, y = np.array(t["f"].to_list(), float), np.array(t["y"].to_list(), float)
    return [np.asarray(p, float).tolist() for p in learner.fit(x, y, t["w"].to_numpy(float), zlib.crc32(t["node"].iloc[0].encode()) + seed)]


MODELS = "node string, used long, params array<array<double>>"


@dataclass
class LeafModels:
    """A model per leaf, as rows (node, used, params); learner: one of functions/forest.py, or anything with its fit and predict."""

    table: DataFrame
    learner: object
    size: int

    @staticmethod
    def fit(rows: DataFrame, sizes: dict[str, int], learner, size: int, classes: int | None = None, sample: int = 2_000, f: str = "f", y: str = "y", key: str = "id", weight: str | None = None, seed: int = 0) -> LeafModels:
        """From rows that have a node; sizes: rows of each node (an upper bound does). classes: y is a class."""
        slim = rows.where(F.col(y).isNotNull()).select("node", F.col(f).cast("array<double>").alias("f"), targets(F.col(y), classes).alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), F.col(key).alias("id"))
        few = sample_leaves(slim, sizes, sample, "id", seed).drop("id")

        def one(t: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"node": [t["node"].iloc[0]], "used": [len(t)], "params": [_fitted(learner, t, seed)]})

        return LeafModels(written(few.groupBy("node").applyInPandas(one, MODELS), "leaf-models"), learner, size)

    def predict(self, rows: DataFrame, f: str = "f", out: str = "prediction") -> DataFrame:
        """rows (with a node) with the outputs of their leaf's model as an array; null where the leaf has none. Models go out in blocks of
        bounded size, a pass each."""
        spark = rows.sparkSession
        width = F.expr("aggregate(params, 0L, (s, p) -> s + 8 * size(p)) + 64")
        blocks, room = [[]], SENT_BYTES
        for r in self.table.select("node", width.alias("b")).orderBy("node").collect():  # a row per leaf
            if blocks[-1] and room < r["b"]:
                blocks.append([])
                room = SENT_BYTES
            blocks[-1].append(r["node"])
            room -= r["b"]
        result = rows.withColumn(out, F.lit(None).cast("array<double>"))
        for names in blocks:
            own = F.broadcast(spark.createDataFrame([(n,) for n in names], "node string"))
            models = {r["node"]: [np.array(p) for p in r["params"]] for r in self.table.join(own, "node").collect()}
            result = result.withColumn(out, _outputs(spark, models, self.learner, self.size)("node", F.col(f), F.col(out)))
        return result


def _outputs(spark: SparkSession, models: dict[str, list[np.ndarray]], learner, size: int) -> Callable[..., Column]:
    sent = spark.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def apply(node: pd.Series, x: pd.Series, before: pd.Series) -> pd.Series:
        made = before.copy()
        for name, own in node.groupby(node).groups.items():
            if name in sent.value:
                got = learner.predict(sent.value[name], np.array(x.loc[own].to_list(), float).reshape(-1, size))
                made.loc[own] = pd.Series(list(got), index=own)
        return made

    return apply


def held_out_loss(learner, classes: int | None = None, sample: int = 2_000, f: str = "f", y: str = "label", key: str = "id", share: float = 0.2, seed: int = 0) -> Callable[[DataFrame, list[dict]], dict[str, float]]:
    """A price for grow(): per node the loss (log loss, or squared error without classes) of a learner on the rows it wasn't fitted on. A
    node's rows are sampled; of those the `share` of highest hash is held out. Nodes with a single class cost nothing."""

    def price(rows: DataFrame, nodes: list[dict]) -> dict[str, float]:
        slim = rows.where(F.col(y).isNotNull()).select("node", F.col(f).cast("array<double>").alias("f"), targets(F.col(y), classes).alias("y"), F.lit(1.0).alias("w"), F.col(key).alias("id"))
        few = sample_leaves(slim, {s["node"]: s["n"] for s in nodes}, sample, "id", seed).drop("id")

        def one(t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values("_h", kind="stable")
            truth = np.array(t["y"].to_list(), float)
            cut = max(1, int(round(len(t) * (1 - share))))
            if cut == len(t) or not np.ptp(truth, axis=0).any():
                return pd.DataFrame({"node": [t["node"].iloc[0]], "loss": [0.0]})
            params = [np.array(p) for p in _fitted(learner, t.iloc[:cut], seed)]
            made = learner.predict(params, np.array(t["f"].iloc[cut:].to_list(), float))
            if classes is None:
                loss = float(((made - truth[cut:]) ** 2).mean())
            else:
                loss = float(-np.log(np.clip(made[np.arange(len(made)), truth[cut:].argmax(axis=1)], 1e-15, 1)).mean())
            return pd.DataFrame({"node": [t["node"].iloc[0]], "loss": [loss]})

        return {r["node"]: r["loss"] for r in few.groupBy("node").applyInPandas(one, "node string, loss double").collect()}  # a row per node

    return price


def nodes_table(spark: SparkSession, tree: KMeansTree) -> DataFrame:
    """(node, n, sse, purity, variance, entropy, distance, centroid, leaf)."""
    cols = ("node", "n", "sse", "purity", "variance", "entropy", "distance", "centroid", "leaf")
    return spark.createDataFrame([tuple(s[c] for c in cols) for s in tree.rows()], "node string, n long, sse double, purity double, variance double, entropy double, distance double, centroid array<double>, leaf boolean")
