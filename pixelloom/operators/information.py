"""Information between features and a class, from nearest neighbours.

Per feature, a value's radius is the distance to the k-th nearest value of its own class (fewer where the class is small); then all values
nearer than that are counted, itself included. In one dimension both need sorted runs only. Values are dealt by range of (feature,
class, value): inside a task radii are known but for the k values at either end of a run, which are settled among the 2k values at the
ends of all runs. Counts are differences of global ranks: both borders of a value's interval are sorted among all values of the
feature, tasks count what they hold, and the counts of the tasks before are added. No task holds a feature.

Defined cases: rows without a whole vector or with a null label are left out, and classes with a single row; ties are exact (a radius of
0 counts equal values); estimates below 0 are 0; an empty table, or one without a class of two rows, has no information on any feature.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.operators.trees import usable
from pixelloom.sources.scratch import written


def digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0: shifted beyond 10, then the asymptotic series."""
    x, out = np.asarray(x, float).copy(), np.zeros(np.shape(x))
    while (small := x < 10).any():
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def kth_distance(v: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to its k-th nearest other one; infinite where there are fewer."""
    n = len(v)
    away = np.full((n, 2 * k), np.inf)
    for j in range(1, min(k, n - 1) + 1):
        gap = v[j:] - v[:-j]
        away[j:, j - 1] = gap
        away[: n - j, k + j - 1] = gap
    return np.sort(away, axis=1)[:, k - 1]


def open_interval(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest double whose computed distance from x is below r; x itself where r is 0."""
    def code(v: np.ndarray) -> np.ndarray:  # doubles as integers in the same order
        i = v.view(np.int64)
        return np.where(i < 0, np.int64(-(1 << 63)) - i, i)

    def value(c: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.where(c < 0, np.int64(-(1 << 63)) - c, c)).view(np.float64)

    def far(sign: float) -> np.ndarray:
        good, bad = code(x + 0.0), code(np.clip(x + sign * (2 * r + 1e-300), -1.7e308, 1.7e308))
        for _ in range(64):
            middle = (good & bad) + ((good ^ bad) >> 1)  # no overflow
            inside = np.abs(value(middle) - x) < r
            good, bad = np.where(inside, middle, good), np.where(inside, bad, middle)
        return np.where(r > 0, value(good), x)

    return far(-1.0), far(1.0)


_RUNS = pa.schema([("kind", pa.int32()), ("feature", pa.int32()), ("y", pa.int64()), ("part", pa.int64()), ("at", pa.int64()), ("x", pa.float64()), ("r", pa.float64())])
_EVENTS = pa.schema([("feature", pa.int32()), ("id", pa.int64()), ("kind", pa.int32()), ("rank", pa.int64()), ("part", pa.int64())])


def _sorted_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    """(feature, class) and its values in this task, one run after the other."""
    now, parts = None, []
    for b in batches:
        f, y, x = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        cut = np.flatnonzero((f[1:] != f[:-1]) | (y[1:] != y[:-1])) + 1
        for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(f)]):
            if a == z:
                continue
            key = (int(f[a]), int(y[a]))
            if key != now and parts:
                yield now, np.concatenate(parts)
                parts = []
            now = key
            parts.append(x[a:z])
    if parts:
        yield now, np.concatenate(parts)


def _rows(kind, feature, y, part, at, x, r) -> pa.RecordBatch:
    n = len(x)
    cols = [np.broadcast_to(c, n) for c in (kind, feature, y, part)] + [at, x, r]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), t.type) for c, t in zip(cols, _RUNS)], schema=_RUNS)


def neighbour_information(rows: DataFrame, size: int, k: int = 3, f: str = "f", label: str = "label") -> DataFrame:
    """(feature, information in nats) of a whole-number class."""
    data = written(usable(rows, size, f).where(F.col(label).isNotNull()).select(F.col(label).cast("long").alias("y"), F.col(f).cast("array<double>").alias("f")), "information-rows")
    sizes = {r[0]: r[1] for r in data.groupBy("y").count().collect() if r[1] > 1}
    n, spark = sum(sizes.values()), rows.sparkSession
    if not n:
        return spark.createDataFrame([], "feature int, mi double")
    near = {y: min(k, c - 1) for y, c in sizes.items()}
    long = data.where(F.col("y").isin(*sizes)).select(F.posexplode("f").alias("feature", "x"), "y", F.monotonically_increasing_id().alias("id"))
    order = ["feature", "y", "x", "id"]
    ranged = long.select("feature", "y", "x", "id").repartitionByRange(*order).sortWithinPartitions(*order)

    def radii(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for (feature, y), v in _sorted_runs(batches):
            j, m = near[y], len(v)
            r, at = kth_distance(v, j), np.arange(m)
            border = (at < 2 * j) | (at >= m - 2 * j)
            done = (at >= j) & (at < m - j)
            yield _rows(0, feature, y, part, at[done], v[done], r[done])
            yield _rows(1, feature, y, part, at[border], v[border], np.where(done[border], 0.0, np.inf))  # r: infinite where it is open

    runs = written(ranged.select("feature", "y", "x").mapInArrow(radii, "kind int, feature int, y long, part long, at long, x double, r double"), "information-runs")

    def settle(t: pa.Table) -> pa.Table:
        t = t.sort_by([("part", "ascending"), ("at", "ascending")])
        x, is_open, y = t["x"].to_numpy(), np.isinf(t["r"].to_numpy()), t["y"][0].as_py()
        r = kth_distance(x, near[y])[is_open]
        return pa.Table.from_batches([_rows(0, t["feature"][0].as_py(), y, 0, np.arange(len(r)), x[is_open], r)], schema=_RUNS)

    # the ends of runs: 4 k values at most for every task and (feature, class)
    ends = runs.where("kind = 1").groupBy("feature", "y").applyInArrow(settle, "kind int, feature int, y long, part long, at long, x double, r double")
    known = runs.where("kind = 0").unionByName(ends).select("feature", "x", "r")

    def borders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, r = b.column(1).to_numpy(), b.column(2).to_numpy()
            low, high = open_interval(x, r)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low), pa.array(high)], names=["feature", "x", "low", "high"])

    points = written(known.mapInArrow(borders, "feature int, x double, low double, high double"), "information-points").withColumn("id", F.monotonically_increasing_id())
    # at equal values a lower border comes first and an upper one last
    three = F.array(F.struct(F.col("low").alias("v"), F.lit(0).alias("kind")), F.struct(F.col("x").alias("v"), F.lit(1).alias("kind")), F.struct(F.col("high").alias("v"), F.lit(2).alias("kind")))
    events = points.select("feature", "id", F.explode(three).alias("e")).select("feature", "id", (F.col("e.v") + F.lit(0.0)).alias("v"), "e.kind")
    order = ["feature", "v", "kind", "id"]
    ranged = events.repartitionByRange(*order).sortWithinPartitions(*order).select("feature", "id", "kind")

    def ranks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            feature, kind = b.column(0).to_numpy(), b.column(2).to_numpy()
            rank = np.zeros(len(feature), np.int64)
            for one in np.unique(feature).tolist():
                own = feature == one
                rank[own] = np.cumsum(kind[own] == 1) + seen.get(one, 0)
                seen[one] = int(rank[own][-1])
            ask = np.flatnonzero(kind != 1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ask)), b.column(1).take(pa.array(ask)), b.column(2).take(pa.array(ask)), pa.array(rank[ask]), pa.array(np.full(len(ask), part, np.int64))], schema=_EVENTS)
        left = list(seen.items())
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in left], pa.int32()), pa.array([-1] * len(left), pa.int64()), pa.array([1] * len(left), pa.int32()), pa.array([c for _, c in left], pa.int64()), pa.array([part] * len(left), pa.int64())], schema=_EVENTS)

    counted = written(ranged.mapInArrow(ranks, "feature int, id long, kind int, rank long, part long"), "information-ranks")
    before, shifts = {}, []
    for feature, part, c in sorted(tuple(r) for r in counted.where("kind = 1").select("feature", "part", "rank").collect()):  # a row per task and feature in it
        shifts.append((feature, part, before.get(feature, 0)))
        before[feature] = before.get(feature, 0) + c
    shift = F.broadcast(spark.createDataFrame(shifts, "feature int, part long, shift long"))
    asked = counted.where("kind <> 1").join(shift, ["feature", "part"])
    inside = asked.groupBy("feature", "id").agg(F.sum((F.col("rank") + F.col("shift")) * (F.col("kind") - 1)).cast("double").alias("m"))

    @F.pandas_udf("double")
    def psi(m):
        import pandas as pd

        return pd.Series(digamma(m.to_numpy()))

    fixed = float(digamma(np.array([n]))[0]) + sum(c / n * float(digamma(np.array([near[y]]))[0] - digamma(np.array([c]))[0]) for y, c in sizes.items())
    return inside.groupBy("feature").agg(F.avg(psi("m")).alias("a")).select("feature", F.greatest(F.lit(0.0), F.lit(fixed) - F.col("a")).alias("mi"))
