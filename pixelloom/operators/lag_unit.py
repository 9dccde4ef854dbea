"""Label-assisted regression whose worst output is split again and again.

Each class is clustered; a row's targets are its shares among the clusters of its own class, by distance; a linear map onto them is
solved from sums. The output of largest entropy (how badly its bins tell the classes) is found, its cluster split in two, the targets
refined and the map solved anew, until no entropy exceeds the threshold, a cluster is too small, or the largest doesn't fall.

A round is five passes whatever the number of outputs: two for the split, one for the sums, one for the outputs' ranges, one for the
counts of their bins. Defined cases: rows with a null label or without a whole vector are left out; an empty table gives no rounds;
constant features have a deviation of 1; the least value of an output is in its first bin; empty bins belong to the first class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.operators import trees
from pixelloom.operators.subspace import _array_udf, moments


def folded(rows: DataFrame, columns: list[str], fold: Callable[[pd.DataFrame], np.ndarray], how: str = "sum") -> np.ndarray:
    """An array per batch, summed (or its greatest numbers taken) over all; empty if there are no rows."""
    def run(batches):
        total = None
        for b in batches:
            if len(b):
                v = fold(b)
                total = v if total is None else total + v if how == "sum" else np.maximum(total, v)
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.ravel().tolist()], pa.list_(pa.float64()))], names=["v"]).to_pandas()

    parts = rows.select(*columns).mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("p", "v"))
    t = parts.groupBy("p").agg((F.sum if how == "sum" else F.max)("v").alias("v")).orderBy("p").collect()
    return np.array([r[1] for r in t])


def shares(x: np.ndarray, y: np.ndarray, centres: np.ndarray, owner: np.ndarray, alpha: float) -> np.ndarray:
    """Targets: exponential shares of the relative distances to the clusters of a row's own class."""
    out = np.zeros((len(x), len(centres)))
    for c in np.unique(y).tolist():
        mine, rows = np.flatnonzero(owner == c), np.flatnonzero(y == c)
        if not len(mine):
            continue
        d = np.sqrt(((x[rows][:, None] - centres[mine]) ** 2).sum(axis=2))
        e = np.exp(-alpha * d / (d.min(axis=1, keepdims=True) + 1e-5))
        out[np.ix_(rows, mine)] = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300)
    return out


def bin_places(z: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    width = np.where(high > low, high - low, 1.0)
    return np.clip(np.ceil((z - low) / width * bins).astype(int) - 1, 0, bins - 1)


def entropies(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """counts: outputs x bins x classes. A bin belongs to the class with the largest share of its own rows there; per output the sum over
    rows of -ln(share of bins that belong to the row's class)."""
    lead = (counts / np.maximum(sizes, 1)).argmax(axis=2)
    p = np.stack([(lead == c).mean(axis=1) for c in range(len(sizes))], axis=1)
    return (-np.log(p + 1e-9) * sizes).sum(axis=1)


@dataclass
class Round:
    """The clusters and the map of one round; w: its last row is the bias."""

    centres: np.ndarray
    owner: np.ndarray
    sizes: np.ndarray
    w: np.ndarray
    entropy: np.ndarray


@dataclass
class LagUnit:
    mean: np.ndarray
    deviation: np.ndarray
    rounds: list[Round] = field(default_factory=list)

    @staticmethod
    def fit(
        rows: DataFrame, size: int, classes: int, per_class: int | list[int], alpha: float = 10.0, rounds: int = 10, threshold: float = 200_000.0, least: int = 50, bins: int = 10,
        must_fall: bool = True, f: str = "f", label: str = "label", steps: int = 10, order: Column | None = None,
    ) -> LagUnit:
        """label: 0 to classes - 1. per_class: first number of clusters of each class (or of all). order: which rows of a class its clusters
        start from."""
        data = trees.usable(rows, size, f).where(F.col(label).isNotNull())
        data = trees.written(data.withColumn("node", F.concat(F.lit("c"), F.col(label).cast("int").cast("string"), F.lit(":"))), "lag")
        mean, deviation = (np.array(v) for v in trees.standardized(data, size, f, label))
        unit = LagUnit(mean, deviation)
        first = [per_class] * classes if isinstance(per_class, int) else per_class
        starts = trees.lowest(data, [f"c{c}:" for c in range(classes)], max(first, default=0), f, order)
        starts = {n: s[: first[int(n[1:-1])]] for n, s in starts.items()}
        if not starts:
            return unit
        centres = trees.settle(data, starts, size, steps, f, label)
        now = trees.written(trees.placed(data, centres, size, f), "lag")
        trees.dropped(data)
        names = [n + trees.DIGITS[k] for c in range(classes) if (n := f"c{c}:") in centres for k in range(len(centres[n]))]
        where = {n + trees.DIGITS[k]: v for n, cs in centres.items() for k, v in enumerate(cs)}
        per = unit._solve(now, names, where, classes, alpha, bins, f, label)
        unit.rounds.append(per)
        for _ in range(rounds):
            last = unit.rounds[-1]
            if last.entropy.max() <= threshold or last.sizes.min() < least:
                break
            worst = [names[k] for k in np.flatnonzero(last.entropy == last.entropy.max())]
            own = trees.sums(now, {n: where[n][None] for n in worst}, size, f, label)
            halves = trees.settle(now, {n: trees._both_sides(trees.figures(n, own[n, 0])) for n in worst if (n, 0) in own}, size, steps, f, label)
            if not halves or any(trees.figures(n, own[n, 0])["sse"] <= 0 for n in halves):
                break  # equal rows can't be split
            split = trees.written(trees.placed(now, halves, size, f), "lag")
            names_ = [m for n in names for m in ([n + "0", n + "1"] if n in halves else [n])]
            where_ = where | {n + trees.DIGITS[k]: c for n, cs in halves.items() for k, c in enumerate(cs)}
            per = unit._solve(split, names_, where_, classes, alpha, bins, f, label)
            if must_fall and per.entropy.max() >= last.entropy.max():
                trees.dropped(split)
                break
            trees.dropped(now)
            now, names, where = split, names_, where_
            unit.rounds.append(per)
        trees.dropped(now)
        return unit

    def _solve(self, rows: DataFrame, names: list[str], where: dict[str, np.ndarray], classes: int, alpha: float, bins: int, f: str, label: str) -> Round:
        centres, owner = np.array([where[n] for n in names]), np.array([int(n[1 : n.index(":")]) for n in names])
        mean, deviation, m, d = self.mean, self.deviation, len(names), centres.shape[1]

        def cut(b: pd.DataFrame) -> dict[int, np.ndarray]:
            if not len(b):
                return {}
            x, y = np.stack(b[f]).astype(float), b[label].to_numpy().astype(int)
            return {0: np.column_stack([(x - mean) / deviation, np.ones(len(x)), shares(x, y, centres, owner, alpha)])}

        found = moments(rows, cut, [f, label])[0]
        s = found.n * (found.cov + np.outer(found.mean, found.mean))
        w = np.linalg.lstsq(s[: d + 1, : d + 1], s[: d + 1, d + 1 :], rcond=None)[0]
        outputs = lambda b: (np.stack(b[f]).astype(float) - mean) / deviation @ w[:-1] + w[-1]
        ends = folded(rows, [f], lambda b: np.concatenate([outputs(b).max(axis=0), (-outputs(b)).max(axis=0)]), "max")
        low, high = -ends[m:], ends[:m]

        def count(b: pd.DataFrame) -> np.ndarray:
            y, at = b[label].to_numpy().astype(int), bin_places(outputs(b), low, high, bins)
            flat = (np.arange(m) * bins + at) * classes + y[:, None]
            return np.bincount(flat.ravel(), minlength=m * bins * classes).astype(float)

        counts = folded(rows, [f, label], count).reshape(m, bins, classes)
        sizes = {r[0]: r[1] for r in rows.groupBy("node").count().collect()}
        return Round(centres, owner, np.array([sizes.get(n, 0) for n in names]), w, entropies(counts, counts[0].sum(axis=0)))

    def transform(self, rows: DataFrame, round_: int = -1, f: str = "f", out: str = "lag") -> DataFrame:
        """Outputs of a round's map for every row with a whole vector; null without rounds."""
        data = trees.usable(rows, len(self.mean), f)
        if not self.rounds:
            return data.withColumn(out, F.lit(None).cast("array<double>"))
        w, mean, deviation = self.rounds[round_].w, self.mean, self.deviation
        return data.withColumn(out, _array_udf(lambda x: (x - mean) / deviation @ w[:-1] + w[-1])(F.col(f)))
