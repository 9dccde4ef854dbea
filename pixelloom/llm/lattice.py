"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected by random Gaussian maps to 8 dimensions and decoded to the nearest point of the E8 lattice, in
several tables. A vector stands in its own cell and probes the cells whose minimal vectors point its way; members of a
cell are compared by exact cosine in double precision. The projection's scale follows the number of vectors, so that
cells hold few unrelated ones, and the number of tables follows from the chance, found by simulation at the threshold itself,
that a pair meets in one table: as many as give MEET, without a cap. Of all scales the one with the least work is taken.

Vectors that are equal are one node with a multiplicity; cells with many members are compared in blocks of BLOCK x BLOCK,
each block pair a task row group of its own. A pair that meets in several cells counts in the first one only.
Defined cases: null or zero vectors and those with null or non-finite components link with nothing and are kept; vectors of
different sizes never link; repeated rows and null ids are allowed (a component's id is the smallest non-null one); an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import MULTIPLIER, drop_scratch, materialize, mix
from pixelloom.llm.graph import components

PROBES = 6
BLOCK = 512
#: The least chance that a pair at the threshold meets, the work of a row of a cell in comparisons, and the least tables.
MEET = 0.97
ROW = 64
LEAST_TABLES = 4


def e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to the rows of x, doubled so that they are whole numbers."""

    def d8(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    take = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(take[:, None], a, b)).astype(np.int64)


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: by rule, all of norm 2."""
    out = []
    for i in range(8):
        for j in range(i):
            for s in (2, -2):
                for t in (2, -2):
                    v = [0] * 8
                    v[i], v[j] = s, t
                    out.append(v)
    for k in range(256):
        v = [1 - 2 * (k >> i & 1) for i in range(8)]
        if v.count(-1) % 2 == 0:
            out.append(v)
    return np.array(out, np.int64)


_NEAR = minimal_vectors()
_CODE = np.array([pow(MULTIPLIER, i + 1, 1 << 64) for i in range(8)], np.uint64)


def _code(points: np.ndarray, table: int) -> np.ndarray:
    return mix((points.astype(np.uint64) * _CODE).sum(axis=-1) + np.uint64(table)).view(np.int64)


def cells(unit: np.ndarray, maps: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """n x tables x (1 + probes) codes of the own cell and the probed ones. maps: tables x dim x 8, scale included."""
    out = np.empty((len(unit), len(maps), 1 + probes), np.int64)
    for t, m in enumerate(maps):
        y = unit @ m
        own = e8(y)
        out[:, t, 0] = _code(own, t)
        if probes:
            toward = (y - own / 2) @ _NEAR.T
            best = np.argpartition(-toward, probes, axis=1)[:, :probes]
            out[:, t, 1:] = _code(own[:, None, :] + _NEAR[best], t)
    return out


def chance(scale: float, cosine: float, probes: int = PROBES, trials: int = 8_000) -> float:
    """Simulated chance that a pair at the threshold meets in one table."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(trials, 8)) * scale
    y = x + rng.normal(size=(trials, 8)) * scale * np.sqrt(2 - 2 * cosine)
    unit = np.eye(8)[None]
    a, b = cells(x, unit, probes)[:, 0], cells(y, unit, probes)[:, 0]
    return float(((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)).mean())


def plan(n: int, cosine: float, probes: int = PROBES) -> tuple[float, int]:
    """(scale, tables) for n vectors: a projection of unit vectors spreads over about (2 pi e scale^2)^4 cells, so a cell holds n over
    that many unrelated ones; the scale of least work, rows and comparisons, is taken."""
    best = None
    for step in range(40):
        scale = 0.3 * 1.12**step
        spread = max(1.0, (2 * np.pi * np.e * scale**2) ** 4)
        met = chance(scale, cosine, probes)
        if met <= 5e-4:  # too few of the trials for a chance to be told
            break
        tables = max(LEAST_TABLES, int(np.ceil(np.log(1 - MEET) / np.log(1 - met)))) if met < 1 else LEAST_TABLES
        work = tables * (1 + probes) * (ROW + n / spread)
        if best is None or work < best[0]:
            best = work, scale, tables
        elif work > 4 * best[0]:
            break
    return best[1], best[2]


def _maps(dim: int, scale: float, tables: int) -> np.ndarray:
    return np.random.default_rng(20240608 + dim).normal(size=(tables, dim, 8)) * scale


def _units(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of unit rows) of lists of equal length."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    x = flat.reshape(len(sizes), -1)
    # the largest component first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def _cell_rows(nodes: DataFrame, scale: float, tables: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, dims = b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, max(1, len(at) // 2000)):
                    unit, _ = _units(b.column(1).take(pa.array(part)))
                    c = cells(unit, _maps(dim, scale, tables)) ^ np.int64(dim)
                    n, t, k = c.shape
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[part], t * k)), pa.array(c.ravel()), pa.array(np.tile(np.arange(k) == 0, n * t))], ["node", "cell", "own"]
                    )

    return nodes.select("node", "v").mapInArrow(run, "node long, cell long, own boolean")


def _first_meeting(ci: np.ndarray, cj: np.ndarray) -> np.ndarray:
    """For pairs (rows of ci and cj: tables x (1 + probes)), the code of the cell where they meet first."""
    same = (ci[:, :, :1] == cj).any(axis=2)
    back = (cj[:, :, :1] == ci).any(axis=2)
    t = (same | back).argmax(axis=1)
    r = np.arange(len(t))
    a, b = ci[r, t, 0], cj[r, t, 0]
    s, k = same[r, t], back[r, t]
    return np.where(s & k, np.minimum(a, b), np.where(s, a, b))


def _compare(rows: pa.Table, cosine: float, scale: float, tables: int):
    """One block pair: (node, weighted number of links that count here, smallest node linked with here)."""
    node, mult, own, side = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(3).to_numpy()
    cell = rows.column(5)[0].as_py()
    unit, sizes = _units(rows.column(4).combine_chunks())
    left, right = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    hit = (unit[left] @ unit[right].T >= cosine) & (own[left][:, None] | own[right][None])
    i, j = np.nonzero(hit)
    i, j = left[i], right[j]
    keep = node[i] < node[j] if not (side == 1).any() else node[i] != node[j]
    i, j = i[keep], j[keep]
    if not len(i):
        return np.zeros((3, 0), np.int64)
    used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = back[: len(back) // 2], back[len(back) // 2 :]
    c = cells(unit[used], _maps(int(sizes[0]), scale, tables)) ^ np.int64(sizes[0])
    counts = np.zeros(len(used), np.int64)
    for at in range(0, len(i), 20_000):
        x, y = i[at : at + 20_000], j[at : at + 20_000]
        here = _first_meeting(c[x], c[y]) == cell
        np.add.at(counts, x[here], mult[used[y[here]]])
        np.add.at(counts, y[here], mult[used[x[here]]])
    label = np.arange(len(used))  # used is in no order of ids: take the smallest id of each component last
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    root = np.full(len(used), np.iinfo(np.int64).max)
    np.minimum.at(root, label, node[used])
    return np.array([node[used], counts, root[label]])


def links(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, counts, comps) over rows (rid, v): nodes (node, v, mult), counts (node, n) of weighted links, comps (node, component).
    A node is the least rid of equal vectors."""
    nodes = materialize(vectors.groupBy("v").agg(F.count("*").alias("mult"), F.min("rid").alias("node")).select("node", "v", "mult"), "lattice-nodes")
    scale, tables = plan(nodes.count(), cosine)
    rows = cells_ = materialize(_cell_rows(nodes, scale, tables), "lattice-cells")
    full = rows.groupBy("cell").agg(F.count("*").alias("c"), F.sum(F.col("own").cast("int")).alias("o")).where("c > 1 and o > 0")
    rows = rows.join(full.select("cell", F.ceil(F.col("c") / block).alias("k")), "cell")
    mine = F.pmod(F.xxhash64("node", "cell"), F.col("k"))
    rows = rows.withColumn("m", mine).withColumn("other", F.explode(F.expr("sequence(cast(0 as bigint), k - 1)")))
    rows = rows.select(
        "cell", "node", "own", F.least("m", "other").alias("x"), F.greatest("m", "other").alias("y"),
        F.when(F.col("m") == F.col("other"), 0).when(F.col("m") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    rows = rows.join(nodes, "node").select("node", "mult", "own", "side", "v", "cell", "x", "y")
    rows = rows.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")

    def run(batches):
        held: list[pa.Table] = []

        def done(t: pa.Table):
            keys = [t.column(c).to_numpy() for c in ("cell", "x", "y")]
            new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
            cuts = np.append(np.flatnonzero(new), t.num_rows)
            made = [_compare(t.slice(s, e - s), cosine, scale, tables) for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if e - s > 1]
            out = np.concatenate(made, axis=1) if made else np.zeros((3, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["node", "n", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            t = pa.concat_tables(held)
            last = [t.column(c)[t.num_rows - 1].as_py() for c in ("cell", "x", "y")]
            same = np.all([t.column(c).to_numpy() == v for c, v in zip(("cell", "x", "y"), last)], axis=0)
            cut = int(same.argmax())
            if cut:
                yield done(t.slice(0, cut))
                held = [t.slice(cut)]
        if held:
            yield done(pa.concat_tables(held))

    found = materialize(rows.mapInArrow(run, "node long, n long, root long").groupBy("node", "root").agg(F.sum("n").alias("n")), "lattice-links")
    drop_scratch(cells_)
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return nodes, counts, comps


def near_duplicates(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per row vec_id, n_links, component_id, kept."""
    kind = table.schema[vector_col].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # single precision moves as it is; cosines are of double precision
    rows = table.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    good = F.expr("v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = materialize(rows.withColumn("v", F.when(good, F.col("v"))), "lattice-rows")
    nodes, counts, comps = links(rows.where("v is not null"), cosine, block)
    rows = materialize(rows.join(nodes.select("v", "node"), "v", "left").select("vec_id", "node"), "lattice-own")
    named = nodes.select("node", "mult").join(counts, "node", "left").join(comps, "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    out = materialize(rows.select("vec_id", "node").join(named, "node", "left"), "lattice-named")
    low = out.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("low"))
    out = out.join(low, "component", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("low")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
