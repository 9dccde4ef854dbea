"""Subspace transforms: PCA, Saab in three variants, and channel-wise trees of them.

Fits need second moments only. Every task sums its own rows (count, sum, cross products, largest norm) for all units of a
layer at once; the sums are added up in two rounds on the executors, and the driver solves D x D problems (D is a window's
size, at most a few hundred). Transforms are matrix products inside Arrow batches.

Defined cases: rows without a vector, or with null components, take no part in fits, and images without pixels neither; null vectors
are transformed to null; a fit on an empty table has no kernels and transforms every vector to an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelloom.functions import grid
from pixelloom.operators.windows import per_image
from pixelloom.sources.config import HopSpec
from pixelloom.sources.scratch import shared_folder

#: Numbers of a batch that windows are cut from at once.
PART = 1 << 16
MOMENTS = "unit long, part long, n long, total array<double>, cross array<double>, norm2 double"


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # population
    norm: float  # largest row norm


def _summed(parts: DataFrame) -> dict[int, Moments]:
    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{
            "unit": key[0], "part": key[1] if len(key) > 1 else 0, "n": int(rows["n"].sum()), "total": np.sum(np.stack(rows["total"]), axis=0),
            "cross": np.sum(np.stack(rows["cross"]), axis=0), "norm2": float(rows["norm2"].max()),
        }])

    first = parts.withColumn("part", F.col("part") % 32).groupBy("unit", "part").applyInPandas(add, MOMENTS)
    out = {}
    for r in first.groupBy("unit").applyInPandas(add, MOMENTS).toPandas().itertuples():
        total, d = np.asarray(r.total), len(r.total)
        mean = total / r.n
        out[int(r.unit)] = Moments(int(r.n), mean, np.asarray(r.cross).reshape(d, d) / r.n - np.outer(mean, mean), float(np.sqrt(r.norm2)))
    return out


def _parts(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows that hold about PART numbers: cut makes windows of every unit of a layer from each number."""
    at, held = 0, 0
    sizes = sum(b[c].map(np.size) for c in b.columns)
    for k, n in enumerate(sizes, 1):
        held += n
        if held >= PART or k == len(b):
            yield b.iloc[at:k].reset_index(drop=True)
            at, held = k, 0


def moments(rows: DataFrame, cut: Callable[[pd.DataFrame], dict[int, np.ndarray]], columns: list[str]) -> dict[int, Moments]:
    """Moments per unit; cut turns a batch, or a part of it, into matrices by unit."""
    def run(batches):
        from pyspark import TaskContext

        sums: dict[int, list] = {}
        for few in (p for b in batches for p in _parts(b)):
            for unit, x in cut(few).items():
                if not len(x):
                    continue
                s = sums.setdefault(unit, [0, 0.0, 0.0, 0.0])
                s[0] += len(x)
                s[1] = s[1] + x.sum(axis=0)
                s[2] = s[2] + x.T @ x
                s[3] = max(s[3], float((x * x).sum(axis=1).max()))
        part = TaskContext.get().partitionId()
        yield pd.DataFrame([{"unit": u, "part": part, "n": s[0], "total": s[1], "cross": s[2].ravel(), "norm2": s[3]} for u, s in sums.items()], columns=["unit", "part", "n", "total", "cross", "norm2"])

    return _summed(rows.select(*columns).mapInPandas(run, MOMENTS))


def whole(rows: DataFrame, f: str = "f") -> DataFrame:
    """Rows whose vector is there and has no null components."""
    return rows.where(F.coalesce(F.forall(f, lambda x: x.isNotNull()), F.lit(False)))


def vector_moments(rows: DataFrame, f: str = "f") -> Moments:
    found = moments(whole(rows, f), lambda b: {0: np.stack(b[f]) if len(b) else np.zeros((0, 0))}, [f])
    return found.get(0, Moments(0, np.zeros(0), np.zeros((0, 0)), 0.0))


def canonical(kernels: np.ndarray) -> np.ndarray:
    """Signs such that each kernel's component of largest size is positive."""
    if not kernels.size:
        return kernels
    at = np.abs(np.round(kernels, 9)).argmax(axis=1)
    return kernels * np.where(kernels[np.arange(len(kernels)), at] < 0, -1.0, 1.0)[:, None]


def principal(cov: np.ndarray, n: int, count: int = -1, legacy_order: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(kernels, energies) of a population covariance, in descending order, variances with n - 1. legacy_order turns the kernels
    round against the energies."""
    values, vectors = np.linalg.eigh(cov * n / max(1, n - 1))
    order = np.argsort(-values, kind="stable")
    count = len(values) if count == -1 else count
    kernels = canonical(vectors.T[order])[:count]
    return (kernels[::-1] if legacy_order else kernels), np.maximum(values[order][:count], 0)


def frequency_choice(kernels: np.ndarray, least: float, mask: str = "plus") -> np.ndarray:
    """Numbers of the square kernels whose share of high frequencies exceeds `least`."""
    side = int(round(np.sqrt(kernels.shape[1])))
    if side * side != kernels.shape[1]:
        raise ValueError("frequencies are chosen for square windows of one channel")
    return np.array([k for k, v in enumerate(kernels) if grid.high_frequency_share(v.reshape(side, side), mask) > least], int)


@dataclass
class PCA:
    """Principal axes; transform doesn't centre. bits: kernels as fixed-point whole numbers."""

    kernels: np.ndarray
    energy: np.ndarray
    mean: np.ndarray
    bits: int | None = None

    @staticmethod
    def fit(rows: DataFrame, count: int = -1, f: str = "f", bits: int | None = None) -> PCA:
        m = vector_moments(rows, f)
        k, e = principal(m.cov, m.n, count)
        return PCA(np.round(k * 2**bits) if bits else k, e, m.mean, bits)

    def transform(self, rows: DataFrame, f: str = "f", out: str = "f") -> DataFrame:
        return rows.withColumn(out, matmul(self.kernels)(F.col(f)))

    def inverse(self, rows: DataFrame, f: str = "f", out: str = "f") -> DataFrame:
        back = np.linalg.pinv(self.kernels).T.copy() if self.kernels.size else self.kernels
        return rows.withColumn(out, matmul(back.T)(F.col(f)))


def matmul(kernels: np.ndarray, before: np.ndarray | float = 0.0, after: np.ndarray | float = 0.0) -> Callable[[Column], Column]:
    """Arrow-batched x -> (x + before) kernels^T + after."""
    return _array_udf(lambda x: (x + before) @ kernels.T + after if kernels.size else np.zeros((len(x), 0)))


@dataclass
class Saab:
    """PCA with a DC kernel and a bias.

    variant v3: bias from raw norms; with a DC the row mean goes first, then the column mean; the mean is taken off in
    transforms only with a DC. v2: column mean, then row mean, always; bias from what is left. v1: as v2 with as many
    kernels as keep `energy_percent`, and a bias from transformed norms."""

    kernels: np.ndarray
    bias: float
    mean: np.ndarray
    energy: np.ndarray
    use_dc: bool = True
    need_bias: bool = True
    variant: str = "v3"
    bits: int | None = None

    @staticmethod
    def from_moments(m: Moments, count: int = -1, use_dc: bool = True, need_bias: bool = True, variant: str = "v3", energy_percent: float | None = None, bits: int | None = None, norm: float | None = None, high_frequency: float | None = None) -> Saab:
        """high_frequency: only kernels (of square windows) with more than this share of their spectrum outside the low frequencies."""
        d = len(m.mean)
        if not m.n:
            return Saab(np.zeros((0, d)), 0.0, np.zeros(d), np.zeros(0), use_dc, need_bias, variant, bits)
        count = d if count == -1 else count
        centre = np.eye(d) - 1.0 / d if use_dc or variant != "v3" else np.eye(d)
        kernels, energy = principal(centre @ m.cov @ centre, m.n, count)
        mean = centre @ m.mean if variant == "v3" else m.mean
        if energy_percent is not None and variant == "v1":
            keep = max(1, int((np.cumsum(energy) / max(energy.sum(), 1e-300) <= energy_percent).sum()))
            kernels, energy = kernels[:keep], energy[:keep]
        if high_frequency is not None:
            chosen = frequency_choice(kernels, high_frequency)
            kernels, energy = kernels[chosen], energy[chosen]
        if use_dc:
            dc = float(np.ones(d) @ m.cov @ np.ones(d)) / d  # variance of the row means times d
            first = np.full((1, d), 1 / np.sqrt(d)) / (np.sqrt(dc) if variant == "v3" and dc > 0 else 1.0)
            last = len(kernels) if high_frequency is not None else max(0, len(kernels) - 1)  # the weakest kernel makes room for the DC
            kernels, energy = np.vstack([first, kernels[:last]]), np.append(dc, energy[:last])
        energy = energy / energy.sum() if energy.sum() else energy
        made = Saab(kernels, (m.norm if norm is None else norm) / np.sqrt(d), mean, energy, use_dc, need_bias, variant)
        if bits is not None:
            if use_dc:
                raise ValueError("fixed point needs use_dc=False")
            made = Saab(np.round(kernels * 2**bits), float(np.round(made.bias * 2**bits + 1)), np.round(mean * 2**bits), made.energy, False, need_bias, variant, bits)
        return made

    @staticmethod
    def fit(rows: DataFrame, f: str = "f", **spec) -> Saab:
        rows = whole(rows, f)
        m = vector_moments(rows, f)
        if spec.get("variant", "v3") == "v3" or not m.n:
            return Saab.from_moments(m, **spec)
        mean = m.mean  # the bias needs a second look at what the means leave
        rest = moments(rows, lambda b: {0: (y := np.stack(b[f]) - mean) - y.mean(axis=1, keepdims=True)} if len(b) else {}, [f])[0]
        made = Saab.from_moments(m, **spec, norm=rest.norm)
        if made.variant == "v1":
            k = made.kernels
            top = moments(rows, lambda b: {0: (np.stack(b[f]) - mean) @ k.T} if len(b) else {}, [f])[0].norm
            made.bias = top
        return made

    def apply(self, x: np.ndarray) -> np.ndarray:
        if not len(self.kernels):
            return np.zeros((*x.shape[:-1], 0))
        bias = self.bias if self.need_bias else 0.0
        mean = self.mean if self.use_dc or self.variant != "v3" else 0.0
        y = (x - mean + bias) @ self.kernels.T
        if self.need_bias and self.use_dc:
            y[..., 0] -= self.bias
        return y

    def dc(self, x: np.ndarray) -> np.ndarray:
        """Means of the windows, after the column means where the variant takes those off."""
        return (x - (self.mean if self.variant != "v3" else 0.0)).mean(axis=-1, keepdims=True)

    def invert(self, y: np.ndarray) -> np.ndarray:
        if not len(self.kernels):
            return np.zeros((*y.shape[:-1], 0))
        bias = self.bias if self.need_bias else 0.0
        y = y.copy()
        if self.need_bias and self.use_dc:
            y[..., 0] += self.bias
        x = y @ np.linalg.pinv(self.kernels.T)
        return x - bias + (self.mean if self.use_dc or self.variant != "v3" else 0.0)

    def transform(self, rows: DataFrame, f: str = "f", out: str = "f") -> DataFrame:
        return rows.withColumn(out, _array_udf(self.apply)(F.col(f)))

    def inverse(self, rows: DataFrame, f: str = "f", out: str = "f") -> DataFrame:
        return rows.withColumn(out, _array_udf(self.invert)(F.col(f)))


def _array_udf(fn: Callable[[np.ndarray], np.ndarray]):
    """fn over the matrix of a batch's vectors; null vectors stay null."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        there = x.notna().to_numpy()
        out = np.full(len(x), None, dtype=object)
        if there.any():
            for k, v in zip(np.flatnonzero(there).tolist(), fn(np.stack(x[there].to_list()))):
                out[k] = v
        return pd.Series(out)

    return run


@dataclass
class ResidualPCA:
    """PCA that keeps the components left after the first ones of a target energy, with a DC; bias over the root of the count."""

    kernels: np.ndarray
    bias: float

    @staticmethod
    def fit(rows: DataFrame, energy_percent: float, f: str = "f") -> ResidualPCA:
        m = vector_moments(rows, f)
        d = len(m.mean)
        if not m.n:
            return ResidualPCA(np.zeros((0, 0)), 0.0)
        centre = np.eye(d) - 1.0 / d
        k, e = principal(centre @ m.cov @ centre, m.n)
        share = np.cumsum(e) / max(e.sum(), 1e-300)
        rest = k[share > 1 - energy_percent][: d - 1]
        kernels = np.vstack([np.full((1, d), 1 / np.sqrt(d)), rest])
        return ResidualPCA(kernels, m.norm / np.sqrt(len(kernels)))

    def transform(self, rows: DataFrame, f: str = "f", out: str = "f") -> DataFrame:
        return rows.withColumn(out, matmul(self.kernels, 0.0, self.bias)(F.col(f)))


@dataclass
class Tree:
    """A channel-wise tree: per layer its units, the parent channel of each, and which channels were split."""

    hops: tuple[HopSpec, ...]
    units: list[list[Saab]] = field(default_factory=list)
    split: list[list[bool]] = field(default_factory=list)  # of the layer before
    energy: list[np.ndarray] = field(default_factory=list)

    def layer(self, k: int, x: np.ndarray) -> np.ndarray:
        """Response of layer k to the response (h x w x channels) of the layer before."""
        return np.concatenate([u.apply(v) for u, v in self._windows(k, x)], axis=2)

    def _windows(self, k: int, x: np.ndarray) -> list[tuple[Saab, np.ndarray]]:
        """The units of a layer with their windows: of one channel each, or of all together."""
        hop = self.hops[k]
        if not hop.channelwise or k == 0 and len(self.split[0]) == 1:
            return [(self.units[k][0], _cut(x, hop))]
        taken = [c for c, s in enumerate(self.split[k]) if s]
        return [(u, _cut(x[:, :, c : c + 1], hop)) for u, c in zip(self.units[k], taken)]

    def window_means(self, x: np.ndarray) -> list[np.ndarray]:
        """Per layer the DC of every unit's windows, a channel each."""
        out = []
        for k in range(len(self.units)):
            out.append(np.concatenate([u.dc(v) for u, v in self._windows(k, x)], axis=2))
            x = self.layer(k, x)
        return out

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for k in range(len(self.units)):
            x = self.layer(k, x)
            out.append(x)
        return out

    def invert(self, responses: np.ndarray, k: int | None = None) -> np.ndarray:
        """Back from the last layer's response; needs every channel split, and windows that don't overlap or a hop's own `ungather`."""
        k = len(self.units) - 1 if k is None else k
        while k >= 0:
            hop, parts, at = self.hops[k], [], 0
            for u in self.units[k]:
                n = len(u.kernels)
                windows = u.invert(responses[:, :, at : at + n])
                parts.append(hop.ungather(windows, hop) if hop.ungather else grid.ungather(windows, hop.window))
                at += n
            responses = np.concatenate(parts, axis=2)
            k -= 1
        return responses

    def params(self, spark: SparkSession) -> DataFrame:
        """The parameter table (layer, unit, k, kernel, energy, bias, mean0)."""
        rows = [(i, j, k, u.kernels[k].tolist(), float(u.energy[k]), float(u.bias), u.mean.tolist()) for i, units in enumerate(self.units) for j, u in enumerate(units) for k in range(len(u.kernels))]
        return spark.createDataFrame(rows, "layer long, unit long, k long, kernel array<double>, energy double, bias double, mean0 array<double>")

    def energies(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, float(e)) for i, es in enumerate(self.energy) for k, e in enumerate(es)], "layer long, k long, energy double")


def _cut(x: np.ndarray, hop: HopSpec) -> np.ndarray:
    if hop.gather:
        return hop.gather(x, hop)
    return grid.gather(x, hop.window, hop.border, hop.pool, hop.stride)


#: Split modes that look at a channel's energy alone.
SPLITS = {"energy": lambda e, t: e > t, "at_least": lambda e, t: e >= t, "below": lambda e, t: e < t}


def fit_tree(images: DataFrame, hops: tuple[HopSpec, ...], split_threshold: float = 0.01, split_mode: str = "energy", changed_only: str | None = None) -> Tree:
    """Fit all layers; one pass over the images per layer gathers the moments of all its units (and, for the modes that look at
    the data, of all candidate channels).

    split_mode energy: a channel's energy exceeds the threshold (at_least: or equals it, below: is less); a hop that isn't channelwise takes
    all channels together, whatever their energy; ratio: its energy over the first principal share of its windows
    reaches it; mean: the mean of |window mean| over |first channel| exceeds it. changed_only: a column with a change map; only
    windows whose centre changed are used to fit."""
    tree = Tree(hops)
    extra = [changed_only] if changed_only else []

    def cut_layer(k: int, channels: list[int] | None):
        def cut(b: pd.DataFrame) -> dict[int, np.ndarray]:
            out: dict[int, list] = {}
            for row in b.itertuples():
                x = grid.as_image(row.px, row.h, row.w, row.c)
                for q in range(k):
                    x = tree.layer(q, x)
                for u, c in enumerate(channels if channels is not None else [None]):
                    v = _cut(x if c is None else x[:, :, c : c + 1], hops[k])
                    if changed_only:
                        m = grid.resize(np.asarray(getattr(row, changed_only), float).reshape(row.h, row.w), v.shape[0], v.shape[1]) != 0
                        v = v[m]
                    out.setdefault(u, []).append(v.reshape(-1, v.shape[-1]))
            return {u: np.concatenate(vs) for u, vs in out.items()}

        return cut

    def spec(hop: HopSpec) -> dict:
        return {"count": hop.kernels, "use_dc": hop.use_dc, "need_bias": hop.need_bias}

    images = images.where("px is not null")
    columns = ["h", "w", "c", "px", *extra]
    if not images.limit(1).count():
        return tree
    for k, hop in enumerate(hops):
        if k == 0:
            n = images.agg(F.max("c")).first()[0] if hop.channelwise else 1
            channels = list(range(n)) if hop.channelwise and n > 1 else None
            found = moments(images, cut_layer(0, channels), columns)
            tree.units.append([Saab.from_moments(found[u], **spec(hop)) for u in sorted(found)])
            tree.split.append([True] * (n if channels else 1))
            tree.energy.append(np.concatenate([u.energy for u in tree.units[0]]))
            continue
        before = tree.energy[k - 1]
        if not hop.channelwise:
            chosen, before = [True] * len(before), np.ones(1)
            found = moments(images, cut_layer(k, None), columns)
        elif split_mode in SPLITS:
            chosen = [bool(SPLITS[split_mode](e, split_threshold)) for e in before]
            wanted = [c for c, s in enumerate(chosen) if s]
            found = moments(images, cut_layer(k, wanted), columns) if wanted else {}
        else:
            every = moments(images, cut_layer(k, list(range(len(before)))), columns)
            chosen = []
            for c, e in enumerate(before):
                m = every[c]
                d = len(m.mean)
                centre = np.eye(d) - 1.0 / d
                values = principal(centre @ m.cov @ centre, m.n)[1]
                if split_mode == "ratio":
                    first = values[0] / values.sum() if values.sum() else np.inf
                    chosen.append(bool(e / first >= split_threshold))
                else:
                    chosen.append(bool(np.abs(m.mean).mean() / max(abs(m.mean[0]), 1e-12) > split_threshold))
            found = dict(enumerate(every[c] for c, s in enumerate(chosen) if s))
        tree.split.append(chosen)
        parents = [before[c] for c, s in enumerate(chosen) if s] if hop.channelwise else [1.0]
        units = [Saab.from_moments(found[u], **spec(hop)) for u in sorted(found)]
        for u, e in zip(units, parents):
            u.energy = u.energy * e
        if not units:
            tree.split.pop()
            break
        tree.units.append(units)
        tree.energy.append(np.concatenate([u.energy for u in units]))
    return tree


def transform_tree(images: DataFrame, tree: Tree, keep_threshold: float | None = None) -> list[DataFrame]:
    """Per hop the images of responses; channels whose energy is below keep_threshold are left out. One pass computes all hops: it is written
    as rows (hop, image), which each hop's table then reads its own of."""
    keep = [np.flatnonzero(e >= keep_threshold) if keep_threshold is not None else np.arange(len(e)) for e in tree.energy]

    def run(batches):
        for b in batches:
            rows = []
            for i, h, w, c, px in zip(b["image_id"], b["h"], b["w"], b["c"], b["px"]):
                for k, y in enumerate(tree.responses(grid.as_image(px, h, w, c))):
                    y = y[:, :, keep[k]]
                    rows.append((i, *y.shape, y.ravel(), k))
            yield pd.DataFrame(rows, columns=["image_id", "h", "w", "c", "px", "hop"])

    made = images.where("px is not null").select("image_id", "h", "w", "c", "px").mapInPandas(run, "image_id long, h int, w int, c int, px array<double>, hop int")
    folder = f"{shared_folder(images.sparkSession)}/hops-{uuid.uuid4().hex}"
    made.write.partitionBy("hop").parquet(folder)
    table = images.sparkSession.read.schema(made.schema).parquet(folder)
    return [table.where(F.col("hop") == k).drop("hop") for k in range(len(tree.units))]


@dataclass
class PixelHop:
    """The feature learner: a channel-wise tree with channels pruned by energy."""

    tree: Tree
    keep_threshold: float

    @staticmethod
    def fit(images: DataFrame, hops: tuple[HopSpec, ...], split_threshold: float = 0.01, keep_threshold: float = 0.001, **settings) -> PixelHop:
        return PixelHop(fit_tree(images, hops, split_threshold, **settings), keep_threshold)

    def transform(self, images: DataFrame, concat: Callable[[list[DataFrame]], DataFrame] | None = None):
        hops = transform_tree(images, self.tree, self.keep_threshold)
        return concat(hops) if concat else hops

    def _kept(self, x: np.ndarray) -> list[np.ndarray]:
        return [y[:, :, e >= self.keep_threshold] for y, e in zip(self.tree.responses(x), self.tree.energy)]

    def context(self, images: DataFrame, h: int, w: int) -> DataFrame:
        """All hops scaled up to h x w, their channels side by side, in one pass over the images and without a join."""
        return per_image(images.where("px is not null"), lambda x: np.concatenate([grid.resize(y, h, w) for y in self._kept(x)], axis=2))

    def inverse(self, images: DataFrame) -> DataFrame:
        """Images from the last hop's responses; see Tree.invert."""
        return per_image(images.where("px is not null"), self.tree.invert)

    def offsets(self, spark: SparkSession, block: int = 25) -> DataFrame:
        from pixelloom.operators.projection import survived_offsets

        return survived_offsets(self.tree.energies(spark), self.keep_threshold, block)


def dilated_tree(images: DataFrame, threshold: float, dilations: tuple[int, ...] = (1, 2, 4, 8)) -> DilatedTree:
    """A tree of 3x3 dilated transforms, a level for each dilation: channels below the threshold are leaves, the others grow on. One pass over
    the images gives the moments of all nodes of a level."""
    tree, level = DilatedTree(dilations), [("R", 1.0)]
    rows = images.where("px is not null")
    for depth in range(len(dilations)):
        names = [n for n, _ in level]

        def cut(b: pd.DataFrame, names=names) -> dict[int, np.ndarray]:
            out: dict[int, list] = {}
            for p, h, w, c in zip(b["px"], b["h"], b["w"], b["c"]):
                seen: dict[str, np.ndarray] = {}
                for u, n in enumerate(names):
                    v = tree.windows(n, grid.as_image(p, h, w, c), seen)
                    out.setdefault(u, []).append(v.reshape(-1, v.shape[-1]))
            return {u: np.concatenate(v) for u, v in out.items()}

        found = moments(rows, cut, ["h", "w", "c", "px"])
        if not found:
            break
        after = []
        for u, (name, energy) in enumerate(level):
            made = Saab.from_moments(found[u])
            share = made.energy * energy
            leaf = share < threshold if depth + 1 < len(dilations) else np.ones(len(share), bool)
            tree.nodes[name], tree.energy[name], tree.leaves[name] = made, share, np.flatnonzero(leaf)
            after += [(f"{name}.{c}", float(share[c])) for c in np.flatnonzero(~leaf).tolist()]
        level = after
        if not level:
            break
    return tree


@dataclass
class DilatedTree:
    """Nodes by path (R.channel.channel...), with the energies of their channels and those that are leaves."""

    dilations: tuple[int, ...]
    nodes: dict[str, Saab] = field(default_factory=dict)
    energy: dict[str, np.ndarray] = field(default_factory=dict)
    leaves: dict[str, np.ndarray] = field(default_factory=dict)

    def windows(self, name: str, x: np.ndarray, seen: dict[str, np.ndarray]) -> np.ndarray:
        """A node's 3x3 dilated windows of an image; seen keeps the responses of the nodes above it."""
        parent, _, channel = name.rpartition(".")
        if parent:
            if parent not in seen:
                seen[parent] = self.nodes[parent].apply(self.windows(parent, x, seen))
            x = seen[parent][:, :, int(channel) : int(channel) + 1]
        return grid.neighbours(x, 1, self.dilations[name.count(".")])

    def transform(self, images: DataFrame) -> DataFrame:
        """Images of the leaf channels of all nodes, side by side, in one pass."""
        def run(x: np.ndarray) -> np.ndarray:
            seen: dict[str, np.ndarray] = {}
            parts = [self.nodes[n].apply(self.windows(n, x, seen))[:, :, self.leaves[n]] for n in self.nodes]
            return np.concatenate(parts, axis=2) if parts else np.zeros((*x.shape[:2], 0))

        return per_image(images.where("px is not null"), run)

    def table(self, spark: SparkSession) -> DataFrame:
        """(node, channel, energy, leaf)."""
        rows = [(n, c, float(e), c in set(self.leaves[n].tolist())) for n in self.nodes for c, e in enumerate(self.energy[n])]
        return spark.createDataFrame(rows, "node string, channel long, energy double, leaf boolean")


def whiten(rows: DataFrame, count: int = -1, f: str = "f") -> tuple[DataFrame, PCA]:
    """Components of unit variance."""
    p = PCA.fit(rows, count, f)
    k = p.kernels / np.sqrt(np.maximum(p.energy, 1e-12))[:, None]
    return rows.withColumn(f, matmul(k, -p.mean)(F.col(f))), p


def standardize(rows: DataFrame, f: str = "f") -> DataFrame:
    """Zero mean and unit population deviation per feature; constant features become 0."""
    m = vector_moments(rows, f)
    s = np.sqrt(np.diag(m.cov))
    k = np.diag(np.where(s > 1e-12, 1 / np.where(s > 1e-12, s, 1), 0.0))
    return rows.withColumn(f, matmul(k, -m.mean)(F.col(f)))


def _flat_windows(x: np.ndarray, size: int) -> np.ndarray:
    v = grid.windows(x, size)
    return v.reshape(*v.shape[:2], -1)


@dataclass
class MultiSaab:
    """Stages of overlapping windows, each a DC and principal axes of the windows' deviations from their means, with a 2x2 maximum between
    them. From the second stage on a bias, the largest norm of a window, goes in before the transform and off the first channel after it.

    The DC is scaled to unit variance. Windows that don't vary take no part in the axes."""

    windows: tuple[int, ...]
    kernels: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    energy: list[np.ndarray] = field(default_factory=list)  # variances along the kept axes
    total: list[float] = field(default_factory=list)  # along all axes

    @staticmethod
    def fit(images: DataFrame, windows: tuple[int, ...], counts: tuple[int, ...] | None = None, energy_percent: float | None = None, per_class: int | None = None, label: str = "label", key: str = "image_id") -> MultiSaab:
        """counts: axes of each stage; else as many as reach energy_percent; else all. per_class: fit on so many images of each class, those that
        come first in a pseudo-random order of their keys. Null images are left out; an empty table gives no stages."""
        from pixelloom.operators.sampling import balanced

        made = MultiSaab(windows)
        rows = images.where("px is not null")
        if per_class is not None:
            rows = balanced(rows, per_class, key, label)
        for k, size in enumerate(windows):
            def cut(b: pd.DataFrame, k=k, size=size) -> dict[int, np.ndarray]:
                if not len(b):
                    return {}
                v = []
                for h, w, c, px in zip(b["h"], b["w"], b["c"], b["px"]):
                    y = grid.as_image(px, h, w, c)
                    for q in range(k):
                        y = made.stage(q, y)
                    v.append(_flat_windows(y, size).reshape(-1, size * size * y.shape[2]))
                v = np.concatenate(v)
                mean = v.mean(axis=1, keepdims=True)
                rest = v - mean
                return {0: rest[rest.std(axis=1) > 0], 1: mean * np.sqrt(v.shape[1]), 2: np.linalg.norm(v, axis=1, keepdims=True)}

            found = moments(rows, cut, ["h", "w", "c", "px"])
            if 0 not in found:
                break
            m, d = found[0], len(found[0].mean)
            axes, energy = principal(m.cov, m.n)
            n = d if counts is None and energy_percent is None else counts[k] if counts is not None else int((np.cumsum(energy) / max(energy.sum(), 1e-300) < energy_percent).sum()) + 1
            dc = float(found[1].cov[0, 0])
            first = np.full((1, d), 1 / np.sqrt(d)) / (np.sqrt(dc) if dc > 0 else 1.0)
            made.kernels.append(np.vstack([first, axes[:n]]))
            made.bias.append(found[2].norm if k else 0.0)
            made.energy.append(energy[:n])
            made.total.append(float(energy.sum()))
        return made

    def stage(self, k: int, x: np.ndarray) -> np.ndarray:
        """Response of a stage to that of the one before, pooled."""
        v = _flat_windows(x, self.windows[k])
        y = (v + np.sqrt(v.shape[-1]) * self.bias[k]) @ self.kernels[k].T
        y[:, :, 0] -= self.bias[k]
        return grid.pool(y)

    def transform(self, images: DataFrame) -> DataFrame:
        """Images of the last stage's responses."""
        def run(x: np.ndarray) -> np.ndarray:
            for k in range(len(self.kernels)):
                x = self.stage(k, x)
            return x

        return per_image(images.where("px is not null"), run)
