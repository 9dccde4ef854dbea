"""Clustering: k-means with given starts, and reports on clusters. Trees are in trees.py."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.joins import nearest_centroid


def kmeans(rows: DataFrame, k: int, f: str = "f", seed: int = 9, max_iter: int = 20):
    """(rows with `cluster`, centres, cost) by the built-in parallel k-means. Rows whose vector is null or holds a null are left out; an
    empty table has no centres and costs nothing."""
    data = rows.where(F.coalesce(F.forall(f, lambda x: x.isNotNull()), F.lit(False)))
    first = data.select(F.size(f)).first()
    if first is None:
        return data.withColumn("cluster", F.lit(0)), [], 0.0
    if k == 1:
        mean, deviation = mean_and_deviation(data, first[0], f)
        return data.withColumn("cluster", F.lit(0)), [mean.tolist()], float((deviation**2).sum()) * data.count()
    data = data.withColumn("_v", array_to_vector(f))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v"), [c.tolist() for c in model.clusterCenters()], model.summary.trainingCost


def minibatch_kmeans(rows: DataFrame, k: int, f: str = "f", key: str = "id", batch: int = 1_000, passes: int = 3, seed: int = 9, candidates: int = 50):
    """(rows with `cluster` and `distance`, centres): centres with counts as state, moved by every batch towards its means.

    Tasks move centres of their own over all their rows, batch after batch, from the same ones; after a pass the centres of all tasks are
    averaged by their counts. Starts are spread (each the farthest from those before, weighed by chance) among k x candidates rows
    of lowest hash of the key, which bounds what the driver holds. Rows whose vector is null or holds a null are left out; an
    empty table has no centres; fewer different rows than k make fewer centres."""
    data = rows.where(F.coalesce(F.forall(f, lambda x: x.isNotNull()), F.lit(False)))
    few = np.array([r[0] for r in data.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k * candidates).select(f).collect()], float)
    if not len(few):
        return data.withColumns({"cluster": F.lit(None).cast("long"), "distance": F.lit(None).cast("double")}), []
    centres = _spread_starts(few, k, np.random.default_rng(seed))
    slim = data.select(F.col(f).cast("array<double>").alias("f"))
    for _ in range(passes):
        start = centres

        def move(batches, start=start):
            c, n = start.copy(), np.zeros(len(start))
            for b in batches:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                for at in range(0, len(x), batch):
                    own = x[at : at + batch]
                    near = ((c * c).sum(axis=1) - 2 * own @ c.T).argmin(axis=1)
                    for j in np.unique(near).tolist():
                        mine = own[near == j]
                        n[j] += len(mine)
                        c[j] += (mine.mean(axis=0) - c[j]) * (len(mine) / n[j])
            v = np.column_stack([n, c * n[:, None]]).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = slim.mapInArrow(move, "v array<double>").select(F.posexplode("v").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v"))
        total = np.array([r[1] for r in parts.orderBy("p").collect()]).reshape(len(centres), -1)  # k x (size + 1) numbers
        centres = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), centres)
    return assign(data, centres.tolist(), f), centres.tolist()


def _spread_starts(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starts drawn one after the other with chances by the squared distance to the nearest one so far."""
    picked = [x[int(rng.integers(len(x)))]]
    far = ((x - picked[0]) ** 2).sum(axis=1)
    while len(picked) < k and far.sum() > 0:
        tried = rng.choice(len(x), size=8, p=far / far.sum())
        best = min(tried.tolist(), key=lambda j: np.minimum(far, ((x - x[j]) ** 2).sum(axis=1)).sum())
        picked.append(x[best])
        far = np.minimum(far, ((x - x[best]) ** 2).sum(axis=1))
    return np.array(picked)


def mean_and_deviation(rows: DataFrame, size: int, f: str = "f") -> tuple[np.ndarray, np.ndarray]:
    r = rows.agg(*[F.avg(F.get(f, F.lit(i))).alias(f"m{i}") for i in range(size)], *[F.stddev_pop(F.get(f, F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
    return np.array([r[i] for i in range(size)], float), np.array([r[size + i] for i in range(size)], float)


def lbg_starts(mean: np.ndarray, deviation: np.ndarray, how: str = "plus") -> list[list[float]]:
    """Two starts: mean and mean + deviation (plus), mean - deviation (minus), or both sides of it (both)."""
    first = mean - deviation if how == "both" else mean
    second = mean - deviation if how == "minus" else mean + deviation
    return [first.tolist(), second.tolist()]


def farthest_starts(rows: DataFrame, size: int, pairs: int = 10, f: str = "f", key: str = "id") -> list[list[float]]:
    """Of the rows farthest from the mean, the two that point most differently (least |cosine|). At most 100 rows are looked at."""
    from pixelloom.operators.topk import farthest

    mean, _ = mean_and_deviation(rows, size, f)
    x = np.array([r[0] for r in farthest(rows, mean.tolist(), min(100, 2 * pairs), f, key).select(f).collect()], float)
    d = x - mean
    d /= np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
    c = np.abs(d @ d.T) + np.eye(len(d)) * 2
    i, j = np.unravel_index(int(c.argmin()), c.shape)
    return [x[i].tolist(), x[j].tolist()]


def assign(rows: DataFrame, centres: list[list[float]], f: str = "f") -> DataFrame:
    """Rows with their nearest centre (`cluster`) and the distance."""
    table = rows.sparkSession.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "centroid long, c array<double>")
    return nearest_centroid(rows, table, f).withColumnRenamed("centroid", "cluster")


def lloyd(rows: DataFrame, centres: list[list[float]], f: str = "f", max_iter: int = 10, tolerance: float = 1e-6) -> tuple[list[list[float]], float]:
    """k-means from given centres: (centres, sum of squared distances). Each step is one pass; rows without a whole vector are left out, no
    rows cost nothing and move nothing."""
    from pixelloom.operators import trees

    size, now, cost = len(centres[0]), np.array(centres, float), float("inf")
    data = trees.usable(rows, size, f).select(F.lit("R").alias("node"), F.col(f).alias("f"), F.lit(0.0).alias("label"))
    for _ in range(max_iter):
        found = trees.sums(data, {"R": now}, size)
        new = np.array([found["R", k].mean if ("R", k) in found else c for k, c in enumerate(now)])
        total, moved = sum(s.sse for s in found.values()), float(np.abs(new - now).max())
        done = moved < tolerance or cost - total <= tolerance * max(1.0, total) and cost != float("inf")
        now, cost = new, float(total)
        if done:
            break
    return now.tolist(), cost


def best_of_trials(rows: DataFrame, size: int, f: str = "f", loss: Callable[[list[list[float]], float], float] | None = None, key: str = "id"):
    """Several starts; the result of least cost, or of least composite loss."""
    mean, deviation = mean_and_deviation(rows, size, f)
    starts = [lbg_starts(mean, deviation, how) for how in ("plus", "minus", "both")] + [farthest_starts(rows, size, f=f, key=key)]
    made = [lloyd(rows, s, f) for s in starts]
    return min(made, key=lambda m: loss(*m) if loss else m[1])


def split_loss(rows: DataFrame, centres: list[list[float]], size: int, sse_parent: float, f: str = "f", label: str = "label") -> float:
    """Balance of the parts + share of the parent's spread + impurity."""
    per = assign(rows, centres, f).groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.col("distance") ** 2).alias("sse"), F.avg(label).alias("p")).collect()
    n = sum(r["n"] for r in per)
    balance = abs(per[0]["n"] - n / 2) / n if per else 1.0
    impurity = sum(r["n"] / n * -sum(q * np.log(max(q, 1e-12)) for q in (r["p"], 1 - r["p"])) for r in per)
    return balance + sum(r["sse"] for r in per) / max(sse_parent, 1e-12) + impurity


def per_cluster_linear(rows: DataFrame, f: str = "f", y: str = "y", cluster: str = "cluster") -> DataFrame:
    """Least squares within each cluster: (cluster, n, w) with the bias last. Tasks add up the normal equations of their clusters; a cluster's
    sums are added up in two rounds, so none gathers a sum from every task. Rows with a null in x or y are left out; null clusters
    are one cluster; an empty table gives no rows."""
    sums = "cluster long, part long, n long, v array<double>"
    slim = rows.select(F.col(cluster).cast("long").alias("cluster"), F.col(f).cast("array<double>").alias("f"), F.col(y).cast("double").alias("y"))
    slim = slim.where(F.col("f").isNotNull() & F.forall("f", lambda x: x.isNotNull()) & F.col("y").isNotNull())

    def add(batches):
        from pyspark import TaskContext

        total: dict[int | None, list] = {}
        for b in batches:
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            x, at = np.array(b.column(1).to_pylist(), float), codes.indices.to_numpy()
            z = np.column_stack([x, np.ones(len(x)), b.column(2).to_numpy()]) if b.num_rows else x
            for k, name in enumerate(codes.dictionary.to_pylist()):
                own = z[at == k]
                s = total.setdefault(name, [0, 0.0])
                s[0], s[1] = s[0] + len(own), s[1] + own.T @ own
        part = TaskContext.get().partitionId() % 32
        cols = [list(total), [part] * len(total), [s[0] for s in total.values()], [s[1].ravel().tolist() for s in total.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64())))], names=["cluster", "part", "n", "v"])

    def join(t: pa.Table) -> pa.Table:
        v = np.sum(t["v"].to_pylist(), axis=0)
        return pa.table({"cluster": t["cluster"][:1], "part": t["part"][:1], "n": [int(np.sum(t["n"].to_numpy()))], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    def solve(t: pa.Table) -> pa.Table:
        one = join(t)
        m = np.array(one["v"][0].as_py())
        d = int(round(len(m) ** 0.5)) - 1
        m = m.reshape(d + 1, d + 1)
        w = np.linalg.lstsq(m[:d, :d], m[:d, d], rcond=None)[0]
        return pa.table({"cluster": one["cluster"], "n": one["n"], "w": pa.array([w.tolist()], pa.list_(pa.float64()))})

    parts = slim.mapInArrow(add, sums).groupBy("cluster", "part").applyInArrow(join, sums)
    return parts.groupBy("cluster").applyInArrow(solve, "cluster long, n long, w array<double>")


def calinski_harabasz(rows: DataFrame, size: int, cluster: str = "cluster", f: str = "f") -> DataFrame:
    """Between-cluster over within-cluster spread, each by its degrees of freedom."""
    long = rows.select(cluster, F.posexplode(f).alias("pos", "x"))
    per = long.groupBy(cluster, "pos").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    every = long.groupBy("pos").agg(F.avg("x").alias("g"))
    sums = per.join(every, "pos").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.countDistinct(cluster).alias("k"), (F.sum("n") / size).alias("n")
    )
    return sums.select((F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("score"))


def sweep(rows: DataFrame, ks: range, trials: int, size: int, f: str = "f", label: str = "label", steps: int = 20) -> DataFrame:
    """k-means for every k and trial: cluster, n, share_within (of label 1) and the Calinski-Harabasz score.

    All runs move together: a pass over the rows sums every cluster of every run, so the number of passes is that of the steps and
    not of the runs. Starts are the rows of lowest hash of each trial. Empty tables give no rows; clusters without rows have none."""
    data = rows.where(F.col(f).isNotNull()).select(F.col(f).alias("f"), F.col(label).cast("double").alias("y"))
    starts = [np.array([r[0] for r in data.orderBy(F.xxhash64("f", F.lit(t)), "f").limit(max(ks)).select("f").collect()], float) for t in range(trials)]
    runs = [(k, t, starts[t][:k]) for k in ks for t in range(trials) if len(starts[t])]
    spark, sums = rows.sparkSession, {}
    for step in range(steps + 1):
        sent = spark.sparkContext.broadcast([c for _, _, c in runs])

        def add(batches, sent=sent):
            total: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                x = np.stack(b.column(0).to_numpy(zero_copy_only=False)).astype(float) if b.num_rows else np.zeros((0, size))
                extra = np.column_stack([np.ones(len(x)), np.nan_to_num(b.column(1).to_numpy(zero_copy_only=False).astype(float)), (x * x).sum(axis=1), x])
                for i, c in enumerate(sent.value):
                    near = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1) if len(x) else np.zeros(0, int)
                    for j in np.unique(near).tolist():
                        total[i, j] = total.get((i, j), 0) + extra[near == j].sum(axis=0)
            rows_ = [{"run": i, "cluster": j, "sums": v.tolist()} for (i, j), v in total.items()]
            yield pa.RecordBatch.from_pylist(rows_, pa.schema([("run", pa.int64()), ("cluster", pa.int64()), ("sums", pa.list_(pa.float64()))]))

        parts = data.mapInArrow(add, "run long, cluster long, sums array<double>").select("run", "cluster", F.posexplode("sums").alias("p", "v"))
        per = parts.groupBy("run", "cluster", "p").agg(F.sum("v").alias("v")).groupBy("run", "cluster").agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("s"))
        sums = {(r["run"], r["cluster"]): np.array([x["v"] for x in r["s"]]) for r in per.collect()}  # bounded by runs x clusters x size
        sent.destroy()
        if step < steps:
            moved = [(k, t, np.array([sums[i, j][3:] / sums[i, j][0] if (i, j) in sums else c[j] for j in range(len(c))])) for i, (k, t, c) in enumerate(runs)]
            still = all(np.allclose(a[2], b[2], atol=1e-9) for a, b in zip(runs, moved))
            runs = moved
            if still:
                break
    out = []
    for i, (k, t, _) in enumerate(runs):
        own = {j: s for (r, j), s in sums.items() if r == i}
        n = sum(s[0] for s in own.values())
        mean = sum(s[3:] for s in own.values()) / n
        between = sum(s[0] * float(((s[3:] / s[0] - mean) ** 2).sum()) for s in own.values())
        within = sum(s[2] - float((s[3:] ** 2).sum()) / s[0] for s in own.values())
        score = float(between / max(len(own) - 1, 1) / (within / max(n - len(own), 1))) if within > 0 else None
        out += [(k, t, j, int(s[0]), float(s[1] / s[0]), score) for j, s in sorted(own.items())]
    return spark.createDataFrame(out, "k int, trial int, cluster long, n long, share_within double, score double")


def leaf_report(before: DataFrame, after: DataFrame, label: str = "label") -> DataFrame:
    """Per leaf of two trees over the same samples: rows that moved, and the purity before and after."""
    both = before.select("sample_id", F.col("node").alias("a"), label).join(after.select("sample_id", F.col("node").alias("b")), "sample_id")
    pure = F.greatest(F.avg(label), 1 - F.avg(label))
    old = both.groupBy(F.col("a").alias("node")).agg(pure.alias("purity_before"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("moved"))
    new = both.groupBy(F.col("b").alias("node")).agg(pure.alias("purity_after"))
    return old.join(new, "node", "full_outer")


