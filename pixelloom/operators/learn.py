"""Learners: least squares on summed normal equations, label-assisted regression, trees, stacking, image decisions.

Defined cases: rows with a null label, target or weight, or without a whole vector, take no part in fits; a model's outputs are null for
rows without a whole vector; a model fitted on an empty table gives null for every row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.vector import arg_max, euclidean, one_hot, soft_target, total
from pixelloom.operators.subspace import _array_udf, moments, whole


@dataclass
class LeastSquares:
    """Multi-output linear regression with a bias (last row of w)."""

    w: np.ndarray

    @staticmethod
    def fit(rows: DataFrame, f: str = "f", targets: str = "y", weight: str | None = None) -> LeastSquares:
        """From sums of [x, 1, y]; a weight multiplies the rows, so that it counts squared in the loss."""
        def cut(b: pd.DataFrame) -> dict[int, np.ndarray]:
            if not len(b):
                return {}
            x, y = np.stack(b[f]), np.stack(b[targets])
            z = np.column_stack([x, np.ones(len(x)), y])
            return {0: z * b[weight].to_numpy()[:, None] if weight else z}

        rows = whole(whole(rows, f), targets)
        found = moments(rows.where(F.col(weight).isNotNull()) if weight else rows, cut, [f, targets, *([weight] if weight else [])])
        if 0 not in found:
            return LeastSquares(np.zeros((0, 0)))
        m, d = found[0], len(rows.select(f).first()[0]) + 1
        s = m.n * (m.cov + np.outer(m.mean, m.mean))
        return LeastSquares(np.linalg.lstsq(s[:d, :d], s[:d, d:], rcond=None)[0])

    def predict(self, rows: DataFrame, f: str = "f", out: str = "scores") -> DataFrame:
        w = self.w
        if not w.size:
            return rows.withColumn(out, F.lit(None).cast("array<double>"))
        return rows.withColumn(out, _array_udf(lambda x: x @ w[:-1] + w[-1])(F.col(f)))


def fit_classifier(rows: DataFrame, classes: int, f: str = "f", label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """Least squares on one-hot labels; predictions are the largest output."""
    model = LeastSquares.fit(rows.withColumn("_y", one_hot(F.col(label), classes)), f, "_y")
    return lambda d: model.predict(d, f).withColumn("prediction", arg_max(F.col("scores")))


@dataclass
class LabelAssisted:
    """Soft targets from class-wise k-means, a linear map onto them, and their sums per class. Targets by encode: shares by distance, the
    nearest cluster (onehot), or its number (raw: transform gives one output, and there are no sums per class)."""

    centres: list[list[float]]
    owner: list[int]  # class of each centre
    model: LeastSquares
    classes: int

    @staticmethod
    def fit(rows: DataFrame, classes: int, per_class: int, alpha: float = 5.0, encode: str = "distance", f: str = "f", label: str = "label") -> LabelAssisted:
        from pixelloom.operators.cluster import kmeans

        centres, owner = [], []
        for c in range(classes):
            _, found, _ = kmeans(rows.where(F.col(label) == c), per_class, f)
            centres += found
            owner += [c] * len(found)
        if not centres:
            return LabelAssisted([], [], LeastSquares(np.zeros((0, 0))), classes)
        rows = whole(rows, f).where(F.col(label).isNotNull())
        own = [F.array(*[F.lit(i) for i, o in enumerate(owner) if o == c]).cast("array<int>") for c in range(classes)]
        points = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
        mine = F.element_at(F.array(*own), F.col(label).cast("int") + 1)
        distances = F.transform(mine, lambda i: euclidean(F.col(f), F.get(points, i)))
        shares = soft_target(distances, alpha)
        if encode == "onehot":
            shares = F.transform(distances, lambda d: (d == F.array_min(distances)).cast("double"))
        if encode == "raw":  # one output, the number of the row's own cluster
            number = F.get("_own", (F.array_position(distances, F.array_min(distances)) - 1).cast("int")).cast("double")
            coded = rows.withColumn("_own", mine).withColumn("_y", F.array(number))
            return LabelAssisted(centres, owner, LeastSquares.fit(coded, f, "_y"), classes)
        coded = rows.withColumn("_own", mine).withColumn("_share", shares)
        coded = coded.withColumn("_y", F.expr(f"transform(sequence(0, {len(centres) - 1}), i -> coalesce(get(_share, cast(array_position(_own, i) - 1 as int)), 0D))"))
        return LabelAssisted(centres, owner, LeastSquares.fit(coded, f, "_y"), classes)

    def transform(self, rows: DataFrame, f: str = "f", out: str = "lag") -> DataFrame:
        return self.model.predict(rows, f, out)

    def predict(self, rows: DataFrame, f: str = "f") -> DataFrame:
        out = self.transform(rows, f, "_lag")
        sums = [sum((F.get("_lag", F.lit(i)) for i, o in enumerate(self.owner) if o == c), F.lit(0.0)) for c in range(self.classes)]
        out = out.withColumn("_p", F.array(*sums))
        out = out.withColumn("probability", F.transform("_p", lambda x: x / total(F.col("_p"))))
        return out.withColumn("prediction", arg_max(F.col("probability"))).drop("_lag", "_p")

    def predict_by_neighbours(self, rows: DataFrame, k: int, alpha: float = 1.0, f: str = "f", key: str = "id") -> DataFrame:
        """Class of the largest exponential vote of the k nearest centres."""
        from pixelloom.operators.joins import centroid_vote

        table = rows.sparkSession.createDataFrame([(i, o, list(map(float, c))) for i, (c, o) in enumerate(zip(self.centres, self.owner))], "centroid long, class long, c array<double>")
        votes = centroid_vote(rows.select(F.col(key).alias("id"), F.col(f).alias("f")), table, k, alpha)
        return votes.groupBy("id").agg(F.max_by("class", F.struct("share", -F.col("class"))).alias("prediction"))


class Fitted:
    """A fitted model as a function on tables that carry the feature array: adds probability, p (of label 1) and prediction."""

    def __init__(self, model, f: str):
        self.model, self.f = model, f

    def __call__(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumns({"probability": F.lit(None).cast("array<double>"), "p": F.lit(None).cast("double"), "prediction": F.lit(None).cast("double")})
        there = F.coalesce(F.forall(self.f, lambda x: x.isNotNull()), F.lit(False))
        blank = F.array_repeat(F.lit(0.0), self.model.numFeatures)
        out = self.model.transform(rows.withColumn("_v", array_to_vector(F.when(there, F.col(self.f)).otherwise(blank))))
        out = out.withColumn("prediction", F.when(there, F.col("prediction")))
        if "probability" in out.columns:
            out = out.withColumn("probability", F.when(there, vector_to_array("probability"))).withColumn("p", F.get("probability", F.lit(1)))
        return out.drop("_v", "rawPrediction")


def _fit(estimator, rows: DataFrame, f: str, label: str) -> Fitted:
    data = whole(rows, f).where(F.col(label).isNotNull())
    if not data.limit(1).count():
        return Fitted(None, f)
    return Fitted(estimator.setFeaturesCol("_v").setLabelCol(label).fit(data.withColumn("_v", array_to_vector(f)).withColumn(label, F.col(label).cast("double"))), f)


def forest(rows: DataFrame, f: str = "f", label: str = "label", trees: int = 100, depth: int = 10, weight: str | None = None, seed: int = 0) -> Fitted:
    e = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    return _fit(e.setWeightCol(weight) if weight else e, rows, f, label)


def forest_regressor(rows: DataFrame, f: str = "f", y: str = "y", trees: int = 50, depth: int = 8, seed: int = 0) -> Fitted:
    return _fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), rows, f, y)


def boosted(rows: DataFrame, f: str = "f", label: str = "label", **params) -> Fitted:
    return _fit(GBTClassifier(**({"maxIter": 20, "maxDepth": 3, "seed": 0} | params)), rows, f, label)


def logistic(rows: DataFrame, f: str = "f", label: str = "label", balanced: bool = True) -> Fitted:
    """balanced: rows weigh by the inverse of their class's share."""
    from pixelloom.sources.scratch import bounded

    if balanced:
        rows = whole(rows, f).where(F.col(label).isNotNull())
        sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
        n, classes = sizes.agg(F.sum("_c"), F.count("*")).first()
        rows = rows.join(bounded(sizes), label).withColumn("_w", F.lit(n or 0) / (F.lit(classes) * F.col("_c"))).drop("_c")
        return _fit(LogisticRegression(weightCol="_w"), rows, f, label)
    return _fit(LogisticRegression(), rows, f, label)


def linear(rows: DataFrame, f: str = "f", y: str = "y") -> Fitted:
    return _fit(LinearRegression(solver="normal"), rows, f, y)


@dataclass
class RadialSVC:
    """A support vector classifier with a radial kernel over landmarks: rows become their kernel values with the landmarks, whitened, and a
    linear machine is fitted on those. With all rows as landmarks it is the exact machine; `residual` states what fewer leave out, the
    mean over rows of the part of the kernel's diagonal (1) that the landmarks don't give."""

    landmarks: np.ndarray
    white: np.ndarray
    w: np.ndarray
    bias: float
    gamma: float
    residual: float

    @staticmethod
    def fit(rows: DataFrame, size: int, gamma: float = 1.0, c: float = 1.0, landmarks: int = 1_000, f: str = "f", label: str = "label", key: str = "id", seed: int = 0, steps: int = 400) -> RadialSVC:
        """landmarks: rows of lowest hash of their key, at most so many; their vectors are all that the driver holds. Rows without a whole
        vector or with a null label are left out; without both classes the machine gives that class, or 0 for an empty table."""
        from pixelloom.operators.trees import usable

        data = usable(rows, size, f).where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(f).cast("array<double>").alias("f"), F.col(label).cast("double").alias("label"))
        x = np.array([r[0] for r in data.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(landmarks).select("f").collect()], float).reshape(-1, size)
        counts = {r[0]: r[1] for r in data.groupBy("label").count().limit(3).collect()}
        if len(counts) < 2:
            return RadialSVC(x[:0], np.zeros((0, 0)), np.zeros(0), 1.0 if counts.get(1.0) else -1.0, gamma, 0.0)
        values, vectors = np.linalg.eigh(_radial(x, x, gamma))
        keep = values > 1e-10 * values.max()
        made = RadialSVC(x, vectors[:, keep] / np.sqrt(values[keep]), np.zeros(int(keep.sum())), 0.0, gamma, 0.0)
        z = data.withColumn("z", made._lift()(F.col("f")))
        made.residual = float(z.agg(F.avg(1 - F.aggregate("z", F.lit(0.0), lambda t, v: t + v * v))).first()[0])
        model = LinearSVC(regParam=1 / (c * sum(counts.values())), maxIter=steps, tol=1e-10, standardization=False, featuresCol="_v", labelCol="label").fit(z.withColumn("_v", array_to_vector("z")))
        made.w, made.bias = model.coefficients.toArray(), float(model.intercept)
        return made

    def _lift(self):
        return _array_udf(lambda v: _radial(v.astype(float), self.landmarks, self.gamma) @ self.white)

    def __call__(self, rows: DataFrame, f: str = "f") -> DataFrame:
        """rows with score and prediction; null where there is no whole vector."""
        x, white, w, bias, gamma = self.landmarks, self.white, self.w, self.bias, self.gamma
        size = x.shape[1]

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            good = [t is not None and len(t) == size and all(a is not None for a in t) for t in v]
            out = np.full(len(v), np.nan)
            if any(good):
                z = np.array([t for t, g in zip(v, good) if g], float)
                out[np.flatnonzero(good)] = _radial(z, x, gamma) @ white @ w + bias if len(x) else bias
            return pd.Series(out)

        out = rows.withColumn("score", F.nanvl(score(F.col(f)), F.lit(None).cast("double")))
        return out.withColumn("prediction", F.when(F.col("score").isNotNull(), (F.col("score") > 0).cast("double")))

    def objective(self, rows: DataFrame, c: float, f: str = "f", label: str = "label") -> float:
        """Half the squared norm of the machine and c times its hinge losses."""
        hinge = self(rows, f).agg(F.sum(F.greatest(F.lit(0.0), 1 - (2 * F.col(label) - 1) * F.col("score")))).first()[0]
        return float(self.w @ self.w / 2 + c * (hinge or 0.0))


def _radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    far = (a * a).sum(axis=1)[:, None] - 2 * a @ b.T + (b * b).sum(axis=1)
    return np.exp(-gamma * np.maximum(far, 0))


def radial_svc(rows: DataFrame, size: int, gamma: float = 1.0, landmarks: int = 1_000, c: float = 1.0, f: str = "f", label: str = "label", seed: int = 0) -> Callable[[DataFrame], DataFrame]:
    """A fitted RadialSVC as a function on tables."""
    return RadialSVC.fit(rows, size, gamma, c, landmarks, f, label, seed=seed)


def cross_validated(rows: DataFrame, grid: list[dict], key: str, folds: int = 3, f: str = "f", label: str = "label") -> tuple[Fitted, dict, float]:
    """Boosted trees by stratified folds and exact area under the curve: (model on all rows, settings, mean area)."""
    from pixelloom.operators.metrics import roc_auc
    from pixelloom.operators.sampling import stratified_folds

    dealt = stratified_folds(rows, key, folds, label).persist()
    scores = []
    for params in grid:
        areas = [roc_auc(boosted(dealt.where(F.col("fold") != k), f, label, **params)(dealt.where(F.col("fold") == k)), "p", label).first()[0] for k in range(folds)]
        scores.append(float(np.mean(areas)))
    dealt.unpersist()
    best = int(np.argmax(scores))
    return boosted(rows, f, label, **grid[best]), grid[best], scores[best]


def random_grid(space: dict[str, list], n: int, seed: int = 0) -> list[dict]:
    """n distinct settings drawn from a space."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < min(n, int(np.prod([len(v) for v in space.values()]))):
        one = {k: v[int(rng.integers(len(v)))] for k, v in space.items()}
        if one not in out:
            out.append(one)
    return out


def stack(rows: DataFrame, ranges: list[tuple[int, int]], f: str = "f", label: str = "label", base: Callable[..., Fitted] = boosted, final: Callable[..., Fitted] = boosted) -> Callable[[DataFrame], DataFrame]:
    """One classifier per range of channels; their probabilities feed a final one."""
    models = [base(rows.withColumn("_s", F.slice(f, a + 1, b - a)), "_s", label) for a, b in ranges]

    def apply(d: DataFrame) -> DataFrame:
        for n, (m, (a, b)) in enumerate(zip(models, ranges)):
            d = m(d.withColumn("_s", F.slice(f, a + 1, b - a))).withColumnRenamed("p", f"_p{n}").drop("probability", "prediction", "_s")
        return d.withColumn("stack", F.array(*[F.col(f"_p{n}") for n in range(len(models))])).drop(*[f"_p{n}" for n in range(len(models))])

    last = final(apply(rows), "stack", label)
    return lambda d: last(apply(d))


def image_vectors(rows: DataFrame, n: int = 2000, by: str = "image_id", order: str = "rank", p: str = "p") -> DataFrame:
    """Per image the probabilities of its first n region pixels, in order, as a feature array."""
    first = rows.where(F.col(order) <= n).groupBy(by).agg(F.sort_array(F.collect_list(F.struct(order, p))).alias("_s"))
    return first.select(by, F.transform("_s", lambda s: s[p]).alias("f"))


def decide_by_share(rows: DataFrame, threshold: float = 0.5, by: str = "image_id", prediction: str = "prediction") -> DataFrame:
    """An image is positive if the share of its positive pixels exceeds the threshold."""
    return rows.groupBy(by).agg(F.avg(F.col(prediction).cast("double")).alias("share")).withColumn("decision", (F.col("share") > threshold).cast("int"))


def dense_labels(rows: DataFrame, label: str = "label") -> DataFrame:
    """Labels renumbered from 0 in their order (column `dense`), whatever their number; null labels are left out."""
    from pixelloom.operators.ranks import ranked
    from pixelloom.sources.scratch import bounded

    names = ranked(rows.where(F.col(label).isNotNull()).select(label).distinct(), label, out="dense").withColumn("dense", F.col("dense").cast("int"))
    return rows.join(bounded(names), label)


def learn(rows: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], label: str = "label") -> Callable[[DataFrame], DataFrame]:
    """A learner that takes one class as well: then it always predicts that."""
    classes = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct().limit(2).collect()]
    if not classes:
        return Fitted(None, "f")
    if len(classes) == 1:
        return lambda d: d.withColumn("prediction", F.lit(float(classes[0]))).withColumn("p", F.lit(1.0))
    return fit(rows)


def cross_apply(cover: DataFrame, stego: DataFrame, of_cover: Callable[[DataFrame], DataFrame], of_stego: Callable[[DataFrame], DataFrame], f: str = "f") -> DataFrame:
    """Rows of both classes through both models; a row's features are those of the cover model followed by the stego model's. The models
    replace the column f and leave the others alone, so one pass does and nothing is joined."""
    every = cover.withColumn("label", F.lit(0)).unionByName(stego.withColumn("label", F.lit(1))).withColumn("_raw", F.col(f))
    first = of_cover(every).withColumn("_a", F.col(f)).withColumn(f, F.col("_raw"))
    return of_stego(first).withColumn(f, F.concat("_a", f)).drop("_a", "_raw")


def fuse_regressions(rows: DataFrame, predictions: list[str], y: str = "y", low: float = 1.0, high: float = 3.0) -> Callable[[DataFrame], DataFrame]:
    """Predictions rescaled to low..high, fused by a linear regression."""
    ends = rows.agg(*[F.min(p).alias(f"a{i}") for i, p in enumerate(predictions)], *[F.max(p).alias(f"b{i}") for i, p in enumerate(predictions)]).first()

    def scaled(d: DataFrame) -> DataFrame:
        cols = [(F.col(p) - ends[f"a{i}"]) / max(ends[f"b{i}"] - ends[f"a{i}"], 1e-12) * (high - low) + low for i, p in enumerate(predictions)]
        return d.withColumn("_f", F.array(*cols))

    model = linear(scaled(rows), "_f", y)
    return lambda d: model(scaled(d)).drop("_f")


def inverse_frequency_weights(rows: DataFrame, y: str = "y", bins: int = 20, least: float = 0.001) -> DataFrame:
    """Weight 1 / max(share of the target's bin, least), whatever the order of rows (column `weight`)."""
    from pixelloom.functions.vector import bin_of

    ends = rows.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.count("*").alias("_n"))
    binned = rows.crossJoin(F.broadcast(ends)).withColumn("_b", bin_of(F.col(y), F.col("_lo"), F.col("_hi"), bins))
    shares = binned.groupBy("_b").agg((F.count("*") / F.max("_n")).alias("_share"))
    return binned.join(F.broadcast(shares), "_b").withColumn("weight", 1 / F.greatest(F.col("_share"), F.lit(least))).drop("_b", "_lo", "_hi", "_n", "_share")


def hop_lag_features(hops: list[DataFrame], classes: int, per_class: int, label_of: DataFrame) -> DataFrame:
    """Per hop label-assisted features of the image's whole response, side by side: (image_id, label, f)."""
    out = label_of
    for n, h in enumerate(hops):
        rows = h.select("image_id", F.col("px").alias("f")).join(label_of, "image_id")
        model = LabelAssisted.fit(rows, classes, per_class)
        out = out.join(model.transform(rows).select("image_id", F.col("lag").alias(f"_l{n}")), "image_id")
    return out.withColumn("f", F.concat(*[F.col(f"_l{n}") for n in range(len(hops))])).drop(*[f"_l{n}" for n in range(len(hops))])
