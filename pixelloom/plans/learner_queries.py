"""Queries of subspace transforms, clustering, learners and feature selection.

Where eigenvectors, seeds or forests decide, results have no SQL; rows are rounded and signs are made canonical."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions import grid
from pixelloom.functions.vector import subtract_mean
from pixelloom.operators import cluster as L
from pixelloom.operators import learn as M
from pixelloom.operators import metrics
from pixelloom.operators import select as N
from pixelloom.operators import subspace as K
from pixelloom.operators.information import neighbour_information
from pixelloom.operators.joins import without
from pixelloom.operators.lag_unit import LagUnit
from pixelloom.operators.sampling import split
from pixelloom.operators.windows import features_of
from pixelloom.plans.fixtures import PX, VX, as_stored, images, read, vectors
from pixelloom.plans.registry import query
from pixelloom.plans.vector_queries import _ENERGY_K, energies, r6
from pixelloom.sources.config import HopSpec

HOPS = (HopSpec(window=2, stride=2, border=None), HopSpec(window=2, stride=2, border=None))
#: Classes 0 and 1 of most learner queries: digits 0-4 and 5-9.
BINARY = "CASE WHEN label >= 5 THEN 1 ELSE 0 END"


def _mirrored(k: str, border: str) -> str:
    """An index of 0 to 7 beyond the border."""
    low, high = ("-1 - " + k, "15 - " + k) if border == "symmetric" else ("-" + k, "14 - " + k)
    return f"CASE WHEN {k} < 0 THEN {low} WHEN {k} > 7 THEN {high} ELSE {k} END"


def _around(border: str, dilate: int = 1) -> str:
    """CTEs up to w(image_id, i, j, n, v, d): the 3x3 surroundings of every pixel."""
    places = _mirrored(f"(c.i + x.a * {dilate})", border), _mirrored(f"(c.j + y.a * {dilate})", border)
    return f"{PX}, o AS (SELECT unnest(range(-1, 2)) AS a), w AS MATERIALIZED (SELECT c.image_id, c.i, c.j, c.d, x.a * 3 + y.a AS n, p.v FROM px c, o x, o y JOIN px p ON p.image_id = c.image_id AND p.i = {places[0]} AND p.j = {places[1]})"


_BLOCKS = f"{PX}, w AS MATERIALIZED (SELECT image_id, i // 2 AS i, j // 2 AS j, (i % 2) * 2 + j % 2 AS n, v FROM px)"


def _dc_share(where: str = "true") -> str:
    """From w: the DC's share of all energy."""
    return f"""r AS (SELECT image_id, i, j, n, v - avg(v) OVER (PARTITION BY image_id, i, j) AS r, sum(v) OVER (PARTITION BY image_id, i, j) / sqrt(count(*) OVER (PARTITION BY image_id, i, j)) AS dc FROM w WHERE {where})
SELECT round(dc / (dc + ac), 6) AS dc_share FROM (SELECT sum(v) AS ac FROM (SELECT var_samp(r) AS v FROM r GROUP BY n)), (SELECT var_pop(dc) AS dc FROM (SELECT DISTINCT image_id, i, j, dc FROM r))"""


def _parts(variant: str) -> str:
    """From l(id, pos, x), vectors of 64: the DC coefficient and the energy of all others."""
    bias = {"v2": "max(sqrt(z2)) / 8", "v1": "max(sqrt(c2))"}[variant]
    return f"""c AS (SELECT id, x - avg(x) OVER (PARTITION BY pos) AS x FROM l), z AS (SELECT id, x, x - avg(x) OVER (PARTITION BY id) AS z FROM c),
e AS (SELECT id, sum(x) AS total, sum(x * x) AS c2, sum(z * z) AS z2 FROM z GROUP BY id), b AS (SELECT {bias} AS bias FROM e)
SELECT id, round((total + 64 * bias) / 8 - bias, 4) AS dc, round(z2, 5) AS ac FROM e, b"""


def _first_share(spark, energy):
    return spark.createDataFrame([(float(np.round(energy[0], 6)),)], "dc_share double")


def binary(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "f", (F.col("label") >= 5).cast("long").alias("label"))


def _values(spark, values, name: str = "value"):
    return spark.createDataFrame([(k, float(np.round(v, 6))) for k, v in enumerate(values)], f"k long, {name} double")


# ---- subspaces ----------------------------------------------------------------------------------


@query()
def pca_energy(spark, sf_dir):
    return _values(spark, K.PCA.fit(vectors(spark, sf_dir)).energy, "energy")


@query(f"""WITH {VX}, l AS MATERIALIZED (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), c AS MATERIALIZED (SELECT a.pos AS i, b.pos AS j, covar_samp(a.x, b.x) AS c FROM l a JOIN l b USING (id) GROUP BY a.pos, b.pos),
s AS MATERIALIZED (SELECT a.i, b.j, sum(a.c * b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 1::BIGINT AS k, (SELECT round(sum(c), 6) FROM c WHERE i = j) AS value UNION ALL SELECT 2, (SELECT round(sum(c), 6) FROM s WHERE i = j)
UNION ALL SELECT 3, (SELECT round(sum(s.c * c.c), 6) FROM s JOIN c ON s.i = c.j AND s.j = c.i) UNION ALL SELECT 4, (SELECT round(sum(a.c * b.c), 6) FROM s a JOIN s b ON a.i = b.j AND a.j = b.i)""")
def pca_moments(spark, sf_dir):
    """Sums of the first to fourth powers of all energies: the traces of the covariance's powers."""
    e = K.PCA.fit(vectors(spark, sf_dir)).energy
    return spark.createDataFrame([(k, float(np.round((e**k).sum(), 6))) for k in (1, 2, 3, 4)], "k long, value double")


@query(f"WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx) SELECT round(sum(v), 6) AS variance FROM (SELECT pos, var_samp(x) AS v FROM l GROUP BY pos)")
def pca_total_variance(spark, sf_dir):
    """The energies of all components add up to the variance of the data."""
    return spark.createDataFrame([(float(np.round(K.PCA.fit(vectors(spark, sf_dir)).energy.sum(), 6)),)], "variance double")


@query(f"WITH {VX} SELECT id, round(f[1], 5) AS first, round(list_sum(f), 4) AS total FROM vx")
def pca_inverse(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    p = K.PCA.fit(rows)
    back = p.inverse(p.transform(rows))
    return back.select("id", F.round(F.get("f", F.lit(0)), 5).alias("first"), F.round(F.expr("aggregate(f, 0D, (s, x) -> s + x)"), 4).alias("total"))


@query()
def saab_fit_transform(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = K.Saab.fit(rows).transform(rows)
    return out.select("id", F.transform("f", r6).alias("f"))


@query(f"""WITH {VX}, b AS (SELECT unnest([false, true]) AS bias) SELECT id, bias, list_transform(f, lambda x: round(x, 5) + 0) AS f FROM vx, b""")
def saab_inverse_error(spark, sf_dir):
    """Without a DC the transform is exactly invertible, with and without a bias: the vectors themselves come back."""
    rows, stored, out = vectors(spark, sf_dir), as_stored(spark, sf_dir), None
    for bias in (False, True):
        s = K.Saab.fit(rows, use_dc=False, need_bias=bias)
        back = s.inverse(s.transform(rows)).select("id", F.lit(bias).alias("bias"), F.transform("f", lambda x: F.round(stored(x), 5) + 0.0).alias("f"))
        out = back if out is None else out.unionByName(back)
    return out


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), m AS (SELECT pos, avg(x) AS m FROM l GROUP BY pos), c AS (SELECT pos, m - (SELECT avg(m) FROM m) AS m FROM m),
r AS (SELECT id, sum(x) AS total, sqrt(sum(x * x)) AS norm FROM l GROUP BY id), k AS (SELECT max(norm) / 8 AS bias, var_pop(total) / 64 AS dc FROM r),
z AS (SELECT id, x - m - avg(x - m) OVER (PARTITION BY id) AS z FROM l JOIN c USING (pos)), e AS (SELECT id, sum(z * z) AS ac FROM z GROUP BY id)
SELECT id, round((total + 64 * bias) / 8 / sqrt(dc) - bias, 5) AS dc, round(ac, 5) AS ac FROM r JOIN e USING (id), k""")
def saab_parts(spark, sf_dir):
    """The DC coefficient of every vector, and the energy of all others: that of the vector without its means, since the kernels are
    orthonormal."""
    rows = vectors(spark, sf_dir)
    out = K.Saab.fit(rows).transform(rows)
    return out.select("id", F.round(F.get("f", F.lit(0)), 5).alias("dc"), F.round(F.expr("aggregate(slice(f, 2, 63), 0D, (s, x) -> s + x * x)"), 5).alias("ac"))


def _two_parts(out):
    return out.select("id", F.round(F.get("f", F.lit(0)), 4).alias("dc"), F.round(F.expr("aggregate(slice(f, 2, 63), 0D, (s, x) -> s + x * x)"), 5).alias("ac"))


@query(f"WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), {_parts('v2')}")
def saab_v2_parts(spark, sf_dir):
    """The second variant: means of columns, then of rows; the bias is the largest norm of what they leave."""
    rows = vectors(spark, sf_dir)
    return _two_parts(K.Saab.fit(rows, variant="v2").transform(rows))


@query(f"WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), {_parts('v1')}")
def saab_v1_parts(spark, sf_dir):
    """The first variant with all kernels: the bias is the largest norm of a response, which is that of the vector without the columns' means."""
    rows = vectors(spark, sf_dir)
    return _two_parts(K.Saab.fit(rows, variant="v1", energy_percent=1.1).transform(rows))


@query()
def saab_variants(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    made = {"v2": K.Saab.fit(rows, variant="v2"), "v1": K.Saab.fit(rows, variant="v1", energy_percent=0.9), "integer": K.Saab.fit(rows, use_dc=False, bits=16)}
    return spark.createDataFrame([(n, len(s.kernels), float(np.round(s.bias, 4)), float(np.round(s.energy[0], 6))) for n, s in made.items()], "variant string, kernels long, bias double, energy double")


@query()
def residual_pca(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    out = K.ResidualPCA.fit(rows, 0.3).transform(rows)
    return out.select("id", F.transform("f", r6).alias("f"))


@query()
def cwsaab_tree(spark, sf_dir):
    """Energies of a two-layer channel-wise tree."""
    tree = K.fit_tree(images(spark, sf_dir), HOPS, 0.02)
    return tree.energies(spark).withColumn("energy", r6("energy"))


@query(f"WITH {PX} SELECT image_id, i, j, round(v, 5) + 0 AS v FROM px")
def cwsaab_inverse(spark, sf_dir):
    """With every channel split and windows that don't overlap the tree is invertible: the pixels come back."""
    hops = tuple(HopSpec(window=2, stride=2, border=None, use_dc=False, need_bias=True) for _ in range(2))
    rows = images(spark, sf_dir)
    tree = K.fit_tree(rows, hops, -1.0)
    back = K.per_image(rows, lambda x: tree.invert(tree.responses(x)[-1]))
    return features_of(back).select("image_id", "i", "j", (F.round(F.get("f", F.lit(0)), 5) + 0.0).alias("v"))


@query(f"""WITH {PX}, w AS (SELECT image_id, i // 2 AS i, j // 2 AS j, (i % 2) * 2 + j % 2 AS n, v FROM px), r AS (SELECT n, v - avg(v) OVER (PARTITION BY image_id, i, j) AS r, avg(v) OVER (PARTITION BY image_id, i, j) * 2 AS dc FROM w),
a AS (SELECT sum(v) AS ac FROM (SELECT var_samp(r) AS v FROM r GROUP BY n)), d AS (SELECT var_pop(dc) AS dc FROM r WHERE n = 0) SELECT 0::BIGINT AS layer, round(dc / (dc + ac), 6) AS dc_share, round(ac / (dc + ac), 6) AS ac_share FROM a, d""")
def cwsaab_root(spark, sf_dir):
    """Shares of the first layer's energy: the DC, and all other channels together."""
    e = K.fit_tree(images(spark, sf_dir), HOPS[:1], 0.02).energy[0]
    return spark.createDataFrame([(0, float(np.round(e[0], 6)), float(np.round(e[1:].sum(), 6)))], "layer long, dc_share double, ac_share double")


@query()
def cwsaab_split_modes(spark, sf_dir):
    rows = images(spark, sf_dir)
    out = []
    for mode, threshold in (("energy", 0.02), ("ratio", 0.05), ("mean", 0.5)):
        tree = K.fit_tree(rows, HOPS, threshold, mode)
        out.append((mode, sum(tree.split[-1]) if len(tree.split) > 1 else 0, len(tree.units)))
    return spark.createDataFrame(out, "mode string, split long, layers long")


_HOP1 = _BLOCKS + """, m AS (SELECT n, avg(v) AS m FROM w GROUP BY n), q AS (SELECT n, m - (SELECT avg(m) FROM m) AS m FROM m),
t AS (SELECT image_id, i, j, sum(v) AS total, sqrt(sum(v * v)) AS norm FROM w GROUP BY ALL), k AS (SELECT max(norm) / 2 AS bias, var_pop(total) / 4 AS dc FROM t),
z AS (SELECT image_id, i, j, v - m - avg(v - m) OVER (PARTITION BY image_id, i, j) AS z FROM w JOIN q USING (n)), e AS (SELECT image_id, i, j, sum(z * z) AS ac FROM z GROUP BY ALL),
hop AS (SELECT image_id, i, j, (total + 4 * bias) / 2 / sqrt(dc) - bias AS dc, ac FROM t JOIN e USING (image_id, i, j), k)"""


@query(f"WITH {_HOP1} SELECT image_id, i, j, round(dc, 5) AS dc, round(ac, 6) AS ac FROM hop")
def pixelhop_first(spark, sf_dir):
    """The first hop without pruning: the DC of every 2x2 window, and the energy of all other channels."""
    rows = images(spark, sf_dir)
    out = features_of(K.PixelHop.fit(rows, HOPS[:1], 0.02, -1.0).transform(rows)[0])
    return out.select("image_id", "i", "j", F.round(F.get("f", F.lit(0)), 5).alias("dc"), F.round(F.expr("aggregate(slice(f, 2, size(f)), 0D, (s, x) -> s + x * x)"), 6).alias("ac"))


@query(f"WITH {_HOP1}, two AS (SELECT unnest(range(2)) AS a) SELECT image_id, i * 2 + x.a AS i, j * 2 + y.a AS j, round(dc, 5) AS dc, round(ac, 6) AS ac FROM hop, two x, two y")
def context_first(spark, sf_dir):
    """The first hop's channels in every pixel's context."""
    rows = images(spark, sf_dir)
    out = features_of(K.PixelHop.fit(rows, HOPS[:1], 0.02, -1.0).context(rows, 8, 8))
    return out.select("image_id", "i", "j", F.round(F.get("f", F.lit(0)), 5).alias("dc"), F.round(F.expr("aggregate(slice(f, 2, size(f)), 0D, (s, x) -> s + x * x)"), 6).alias("ac"))


@query()
def pixelhop(spark, sf_dir):
    """Features of both hops, weak channels pruned."""
    hops = K.PixelHop.fit(images(spark, sf_dir), HOPS, 0.02, 0.001).transform(images(spark, sf_dir))
    return features_of(hops[-1]).select("image_id", "i", "j", F.transform("f", r6).alias("f"))


@query()
def pixelhop_context(spark, sf_dir):
    """Hops scaled up to the image and put side by side per pixel."""
    rows = images(spark, sf_dir)
    return features_of(K.PixelHop.fit(rows, HOPS, 0.02, 0.001).context(rows, 8, 8)).select("image_id", "i", "j", F.transform("f", r6).alias("f"))


@query()
def pixelhop_offsets(spark, sf_dir):
    return K.PixelHop.fit(images(spark, sf_dir), HOPS, 0.02, 0.001).offsets(spark, 4)


@query(f"WITH {_around('symmetric')}, {_dc_share('d = 1')}")
def point_label_root(spark, sf_dir):
    """The DC's share where kernels are fitted on windows whose centre changed."""
    rows = images(spark, sf_dir).withColumn("diff", F.expr("transform(px, (x, p) -> if((image_id * 7 + p * 13) % 5 = 0, 1D, 0D))"))
    return _first_share(spark, K.fit_tree(rows, (HopSpec(window=3),), changed_only="diff").energy[0])


@query(f"WITH {_around('reflect')}, {_dc_share()}")
def dilated_root(spark, sf_dir):
    """The DC's share in the root of a dilated tree."""
    return _first_share(spark, K.dilated_tree(images(spark, sf_dir), 0.02, (1,)).energy["R"])


@query(f"WITH {_around('reflect', 2)}, {_dc_share()}")
def hop_unit_root(spark, sf_dir):
    """The DC's share in a unit of 3x3 neighbourhoods, dilated by 2, that keeps all kernels."""
    from pixelloom.operators.hop_unit import fit_chain

    return _first_share(spark, fit_chain(images(spark, sf_dir), [{"reach": 1, "dilate": 2}], 1.1).units[0].energy)


@query()
def point_label_fit(spark, sf_dir):
    """Kernels fitted on windows whose centre changed, applied to all."""
    rows = images(spark, sf_dir).withColumn("diff", F.expr("transform(px, (x, p) -> if((image_id * 7 + p * 13) % 5 = 0, 1D, 0D))"))
    tree = K.fit_tree(rows, (HopSpec(window=3),), changed_only="diff")
    return tree.energies(spark).withColumn("energy", r6("energy"))


@query()
def dilated_tree(spark, sf_dir):
    return K.dilated_tree(images(spark, sf_dir), 0.02, (1, 2, 4)).table(spark).withColumn("energy", r6("energy"))


@query()
def dilated_features(spark, sf_dir):
    """Leaf channels of a dilated tree, per pixel."""
    rows = images(spark, sf_dir)
    return features_of(K.dilated_tree(rows, 0.05, (1, 2)).transform(rows)).select("image_id", "i", "j", F.transform("f", r6).alias("f"))


@query()
def joint_tree(spark, sf_dir):
    """A tree whose second layer takes all channels together; energies of both layers."""
    hops = (HOPS[0], HopSpec(window=2, stride=2, border=None, channelwise=False))
    return K.fit_tree(images(spark, sf_dir), hops).energies(spark).withColumn("energy", r6("energy"))


@query()
def hop_units(spark, sf_dir):
    """Two hops of units: energies of their channels, and the channels that they come from."""
    from pixelloom.operators.hop_unit import below, fit_chain

    chain = fit_chain(images(spark, sf_dir), [{"reach": 1, "channelwise": False}, {"reach": 1, "dilate": 2}], 0.95, below(0.3))
    return chain.table(spark).withColumn("energy", r6("energy"))


@query()
def frequency_saab(spark, sf_dir):
    """Kernels of 5x5 windows, chosen by their share of high frequencies."""
    cut = K.per_image(images(spark, sf_dir), lambda x: grid.gather(x, 5, "reflect"))
    made = K.Saab.fit(features_of(cut), variant="v2", use_dc=False, high_frequency=0.8)
    rows = [(k, float(np.round(e, 6)), float(np.round(grid.high_frequency_share(v.reshape(5, 5), "plus"), 6))) for k, (v, e) in enumerate(zip(made.kernels, made.energy))]
    return spark.createDataFrame(rows, "k long, energy double, share double")


@query(f"""WITH {PX}, o AS (SELECT unnest(range(3)) AS a), w AS (SELECT c.image_id, c.i, c.j, x.a * 3 + y.a AS n, p.v FROM px c, o x, o y, px p WHERE c.i <= 5 AND c.j <= 5 AND p.image_id = c.image_id AND p.i = c.i + x.a AND p.j = c.j + y.a),
r AS (SELECT n, v - avg(v) OVER (PARTITION BY image_id, i, j) AS r, avg(v) OVER (PARTITION BY image_id, i, j) * 3 AS dc, sqrt(sum(v * v) OVER (PARTITION BY image_id, i, j)) AS norm FROM w)
SELECT (SELECT round(sum(v), 6) FROM (SELECT var_samp(r) AS v FROM r GROUP BY n)) AS variance, (SELECT round(1 / sqrt(var_pop(dc)) / 3, 6) FROM r WHERE n = 0) AS dc_weight""")
def multi_saab_energy(spark, sf_dir):
    """Variances along all axes of the first stage add up to that of the windows; the DC has unit variance."""
    made = K.MultiSaab.fit(images(spark, sf_dir), (3, 2))
    return spark.createDataFrame([(float(np.round(made.total[0], 6)), float(np.round(made.kernels[0][0, 0], 6)))], "variance double, dc_weight double")


@query()
def multi_saab(spark, sf_dir):
    """Responses of two stages, fitted on as many images of each class."""
    rows = images(spark, sf_dir)
    made = K.MultiSaab.fit(rows, (3, 2), energy_percent=0.9, per_class=20)
    return features_of(made.transform(rows)).select("image_id", "i", "j", F.transform("f", r6).alias("f"))


@query()
def residual_learning(spark, sf_dir):
    """Whitened components ranked by the held-out loss of a forest on each, the best 27 kept."""
    from pixelloom.operators.topk import best_features

    white, _ = K.whiten(vectors(spark, sf_dir))
    return best_features(N.forest_entropy(white, 64, 10), 27, "ce").withColumn("ce", r6("ce"))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), s AS (SELECT id, pos, (x - avg(x) OVER (PARTITION BY pos)) / stddev_pop(x) OVER (PARTITION BY pos) AS z FROM l)
SELECT id, round(max(z), 5) AS largest, round(sum(z), 4) AS total FROM s GROUP BY id""")
def standardize(spark, sf_dir):
    out = K.standardize(vectors(spark, sf_dir))
    return out.select("id", F.round(F.array_max("f"), 5).alias("largest"), F.round(F.expr("aggregate(f, 0D, (s, x) -> s + x)"), 4).alias("total"))


# ---- clusters -----------------------------------------------------------------------------------


@query()
def kmeans(spark, sf_dir):
    placed, _, _ = L.kmeans(vectors(spark, sf_dir), 10)
    return placed.groupBy("cluster").count()


@query()
def minibatch_kmeans(spark, sf_dir):
    placed, _ = L.minibatch_kmeans(vectors(spark, sf_dir), 4, batch=100)
    return placed.groupBy("cluster").agg(F.count("*").alias("n"), r6(F.sum(F.col("distance") ** 2)).alias("cost"))


@query()
def cluster_sweep(spark, sf_dir):
    rows = binary(spark, sf_dir)
    return L.sweep(rows, range(5, 16), 10, 64).select("k", "trial", "cluster", "n", r6("share_within").alias("share_within"), F.round("score", 4).alias("score"))


@query(f"""WITH {VX}, l AS (SELECT label, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), p AS (SELECT label, pos, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY label, pos),
g AS (SELECT pos, avg(x) AS g FROM l GROUP BY pos), s AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(n * v) AS w, count(DISTINCT label) AS k, sum(n) / 64 AS n FROM p JOIN g USING (pos))
SELECT round(b / (k - 1) / (w / (n - k)), 6) AS score FROM s""")
def calinski_harabasz(spark, sf_dir):
    return L.calinski_harabasz(vectors(spark, sf_dir), 64, "label").withColumn("score", r6("score"))


@query("""SELECT (l_linenumber)::BIGINT AS cluster, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem GROUP BY l_linenumber""")
def per_cluster_linear(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("cluster"), F.array("l_quantity").alias("f"), F.col("l_extendedprice").alias("y"))
    return L.per_cluster_linear(rows).select("cluster", "n", F.round(F.get("w", F.lit(0)), 3).alias("slope"), F.round(F.get("w", F.lit(1)), 1).alias("intercept"))


# ---- learners -----------------------------------------------------------------------------------


def solved(n: int) -> str:
    """CTE s(w): the solutions of the normal equations in e(m), a matrix with the right-hand sides as further columns, by elimination."""
    return f"""s0(k, m) AS (SELECT 1, m FROM e UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k])
  ELSE list_transform(list_zip(r, m[k]), lambda z: z[1] - r[k] * z[2] / m[k][k]) END) FROM s0 WHERE k <= {n}), s AS MATERIALIZED (SELECT m AS w FROM s0 WHERE k = {n} + 1)"""


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 1) AS intercept FROM lineitem")
def least_squares(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.array("l_quantity").alias("f"), F.array("l_extendedprice").alias("y"))
    w = M.LeastSquares.fit(rows).w
    return spark.createDataFrame([(float(np.round(w[0, 0], 3)), float(np.round(w[1, 0], 1)))], "slope double, intercept double")


@query(f"""WITH RECURSIVE {VX}, x AS MATERIALIZED (SELECT id, label, list_append(f, 1.0) || list_transform(range(10), lambda c: (c = label)::INT::DOUBLE) AS z, (id * 2654435761 + 42 * 40503) % 1000003 < 0.2 * 1000003 AS test FROM vx),
l AS MATERIALIZED (SELECT id, unnest(range(75)) AS p, unnest(z) AS v FROM x WHERE NOT test), g AS (SELECT a.p AS i, b.p AS j, sum(a.v * b.v) AS v FROM l a JOIN l b USING (id) WHERE a.p < 65 GROUP BY a.p, b.p),
e AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i)), {solved(65)},
o AS (SELECT id, label, list_transform(range(10), lambda c: list_sum(list_transform(range(1, 66), lambda i: z[i] * w[i][66 + c]))) AS o FROM x, s WHERE test)
SELECT id, label, (list_position(o, list_max(o)) - 1)::INT AS prediction FROM o""")
def llsr(spark, sf_dir):
    train, test = split(vectors(spark, sf_dir), "id")
    return M.fit_classifier(train, 10)(test).select("id", "label", "prediction")


@query(f"""WITH RECURSIVE {VX}, n AS (SELECT min(f[1]) AS lo, max(f[1]) AS hi, count(*) AS n FROM vx), b AS (SELECT id, f, least(19, floor((f[1] - lo) / (hi - lo) * 20)) AS bin, n FROM vx, n),
x AS MATERIALIZED (SELECT id, list_append(f[2:64], 1.0) || [f[1]] AS z, 1 / greatest(count(*) OVER (PARTITION BY bin) / n, 0.001) AS w FROM b),
l AS MATERIALIZED (SELECT id, unnest(range(65)) AS p, unnest(z) * w AS v FROM x), g AS (SELECT a.p AS i, b.p AS j, sum(a.v * b.v) AS v FROM l a JOIN l b USING (id) WHERE a.p < 64 GROUP BY a.p, b.p),
e AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM g GROUP BY i)), {solved(64)}
SELECT k, round(w[k + 1][65], 5) AS w FROM s, (SELECT unnest(range(64)) AS k)""")
def weighted_llsr(spark, sf_dir):
    rows = M.inverse_frequency_weights(vectors(spark, sf_dir).withColumn("t", F.get("f", F.lit(0))), "t").withColumn("y", F.array("t"))
    w = M.LeastSquares.fit(rows.withColumn("f", F.slice("f", 2, 63)), weight="weight").w
    return spark.createDataFrame([(k, float(np.round(v, 5))) for k, v in enumerate(w[:, 0])], "k long, w double")


@query()
def lag(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return M.LabelAssisted.fit(rows, 10, 2).predict(rows).select("id", "label", "prediction")


@query()
def lag_raw(spark, sf_dir):
    """A single output: the number of the cluster within its class, as a number."""
    rows = vectors(spark, sf_dir)
    return M.LabelAssisted.fit(rows, 10, 2, encode="raw").transform(rows).select("id", "label", F.round(F.get("lag", F.lit(0)), 4).alias("number"))


@query()
def lag_unit(spark, sf_dir):
    """Outputs of the last round of a label-assisted unit that splits its worst output."""
    rows = vectors(spark, sf_dir)
    unit = LagUnit.fit(rows, 64, 10, 2, threshold=100.0, least=10)
    return unit.transform(rows).select("id", "label", F.transform("lag", lambda x: F.round(x, 5)).alias("lag"))


@query()
def lag_rounds(spark, sf_dir):
    """Outputs and entropies of every round."""
    unit = LagUnit.fit(vectors(spark, sf_dir), 64, 10, 2, threshold=100.0, least=10)
    out = [(k, j, int(r.owner[j]), int(r.sizes[j]), float(np.round(r.entropy[j], 4))) for k, r in enumerate(unit.rounds) for j in range(len(r.owner))]
    return spark.createDataFrame(out, "round long, output long, class long, n long, entropy double")


@query()
def lag_neighbours(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return M.LabelAssisted.fit(rows, 10, 2).predict_by_neighbours(rows, 3)


@query()
def boosted_cv(spark, sf_dir):
    """Boosted trees, settings chosen by stratified folds."""
    rows = binary(spark, sf_dir)
    grid = M.random_grid({"maxIter": [3], "maxDepth": [2, 3]}, 2)
    model, best, _ = M.cross_validated(rows, grid, "id", 2)
    return model(rows).select("id", r6("p").alias("p"))


@query()
def random_forest(spark, sf_dir):
    rows = binary(spark, sf_dir)
    return M.forest(rows, trees=10, depth=4)(rows).select("id", r6("p").alias("p"))


@query()
def forest_regression(spark, sf_dir):
    rows = binary(spark, sf_dir).withColumn("y", F.get("f", F.lit(0)) * 2)
    return M.forest_regressor(rows, trees=5, depth=4)(rows).select("id", r6("prediction").alias("prediction"))


@query()
def radial_svc(spark, sf_dir):
    rows = binary(spark, sf_dir)
    return M.radial_svc(rows, 64, 1.0)(rows).select("id", F.round("score", 3).alias("score"), "prediction")


@query()
def logistic_stacker(spark, sf_dir):
    rows = binary(spark, sf_dir)
    return M.logistic(rows)(rows).select("id", F.round("p", 4).alias("p"))


@query()
def stack_gbt(spark, sf_dir):
    rows = binary(spark, sf_dir)
    small = lambda d, f, label: M.boosted(d, f, label, maxIter=3, maxDepth=2)
    return M.stack(rows, [(0, 32), (32, 64)], base=small, final=small)(rows).select("id", "label", r6("p").alias("p"))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), m AS (SELECT id, avg(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS share FROM l GROUP BY id)
SELECT id AS image_id, round(share, 6) AS share, CASE WHEN share > 0.5 THEN 1 ELSE 0 END AS decision FROM m""")
def image_decision(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("id").alias("image_id"), F.explode("f").alias("x")).withColumn("prediction", (F.col("x") > 0).cast("int"))
    return M.decide_by_share(rows).withColumn("share", r6("share"))


@query(f"WITH {VX} SELECT id AS image_id, 20::BIGINT AS n, round(list_sum(f[1:20]), 6) AS total FROM vx")
def image_vectors(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.col("id").alias("image_id"), F.posexplode("f").alias("pos", "p")).withColumn("rank", F.col("pos") + 1)
    out = M.image_vectors(rows, 20)
    return out.select("image_id", F.size("f").cast("long").alias("n"), r6(F.expr("aggregate(f, 0D, (s, x) -> s + x)")).alias("total"))


@query("SELECT doc_id, source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS dense FROM documents")
def dense_labels(spark, sf_dir):
    return M.dense_labels(read(spark, sf_dir, "documents").select("doc_id", "source"), "source").select("doc_id", "source", "dense")


@query(f"WITH {VX} SELECT id, {BINARY}::BIGINT AS label, 1.0::DOUBLE AS prediction FROM vx WHERE label >= 5")
def one_class_learner(spark, sf_dir):
    rows = binary(spark, sf_dir).where("label = 1")
    return M.learn(rows, lambda d: M.logistic(d))(rows).select("id", "label", "prediction")


@query(f"""WITH {VX} SELECT id, l AS label, round(list_sum(list_transform(f, lambda x: 2 * x)) + list_sum(list_transform(f, lambda x: 3 * x)), 6) AS total FROM vx, (SELECT unnest([0, 1]) AS l)""")
def cross_apply(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", "f")
    times = lambda k: lambda d: d.withColumn("f", F.transform("f", lambda x: x * k))
    out = M.cross_apply(rows, rows, times(2), times(3))
    return out.select("id", "label", r6(F.expr("aggregate(f, 0D, (s, x) -> s + x)")).alias("total"))


@query(f"WITH {VX} SELECT id, round(2 * f[1] + f[2], 4) AS prediction FROM vx")
def fuse_regressions(spark, sf_dir):
    """The target is a sum of the predictions that are fused, so it comes out."""
    rows = vectors(spark, sf_dir).select("id", F.get("f", F.lit(0)).alias("a"), F.get("f", F.lit(1)).alias("b"), (F.get("f", F.lit(0)) * 2 + F.get("f", F.lit(1))).alias("y"))
    return M.fuse_regressions(rows, ["a", "b"])(rows).select("id", F.round("prediction", 4).alias("prediction"))


@query()
def hop_lag(spark, sf_dir):
    """Label-assisted features of each hop, then a forest."""
    rows = images(spark, sf_dir)
    hops = K.PixelHop.fit(rows, HOPS[:1], 0.02, 0.01).transform(rows)
    pooled = [K.per_image(h, lambda x: x.mean(axis=(0, 1), keepdims=True)) for h in hops]
    made = M.hop_lag_features(pooled, 10, 1, rows.select("image_id", "label"))
    return made.select("image_id", "label", F.transform("f", r6).alias("f"))


# ---- selection ----------------------------------------------------------------------------------

_BINS = f"""{VX}, l AS (SELECT {BINARY} AS y, unnest(range(64)) AS feature, unnest(f) AS x FROM vx), e AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM l GROUP BY feature),
c AS (SELECT feature, least(9, greatest(0, floor((x - lo) / (hi - lo) * 10)))::BIGINT AS bin, y, count(*) AS n FROM l JOIN e USING (feature) WHERE hi > lo GROUP BY ALL)"""


@query(f"""WITH {_BINS}, z AS (SELECT {BINARY} AS y, count(*) AS size FROM vx GROUP BY 1), s AS (SELECT feature, bin, y, row_number() OVER (PARTITION BY feature, bin ORDER BY n / size DESC, y) AS r FROM c JOIN z USING (y)),
d AS (SELECT feature, y, count(*) AS led FROM s WHERE r = 1 GROUP BY feature, y), u AS (SELECT feature, count(*) AS used FROM s WHERE r = 1 GROUP BY feature),
p AS (SELECT u.feature, z.y, size, (coalesce(led, 0) + CASE WHEN z.y = 0 THEN 10 - used ELSE 0 END) / 10.0::DOUBLE AS p FROM u CROSS JOIN z LEFT JOIN d ON d.feature = u.feature AND d.y = z.y)
SELECT feature, round(sum(size * -log10(p + 1e-5) / log10(2)) / sum(size), 6) AS ce FROM p GROUP BY feature""")
def bin_entropy(spark, sf_dir):
    return N.bin_entropy(binary(spark, sf_dir), 2).select(F.col("feature").cast("long").alias("feature"), r6("ce").alias("ce"))


@query(f"WITH {_BINS}, p AS (SELECT feature, n, n / sum(n) OVER (PARTITION BY feature, bin) AS p FROM c) SELECT feature, round(sum(-ln(p) * n), 4) AS ce FROM p GROUP BY feature")
def correct_class_entropy(spark, sf_dir):
    return N.correct_class_entropy(binary(spark, sf_dir)).select(F.col("feature").cast("long").alias("feature"), F.round("ce", 4).alias("ce"))


@query(f"""WITH {_BINS}, m AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b, sum(n) OVER (PARTITION BY feature, y) AS k FROM c)
SELECT feature, round(sum(n / t * ln(n * t / (b * k))), 6) AS mi FROM m GROUP BY feature""")
def binned_mi(spark, sf_dir):
    return N.mutual_information(binary(spark, sf_dir)).select(F.col("feature").cast("long").alias("feature"), r6("mi").alias("mi"))


@query(f"""WITH {VX}, l AS MATERIALIZED (SELECT id, {BINARY} AS y, unnest(range(64)) AS feature, unnest(f) AS x FROM vx), n AS (SELECT {BINARY} AS y, count(*) AS c FROM vx GROUP BY 1),
psi AS (SELECT k, -0.57721566490153286 + coalesce(sum(CASE WHEN k > 1 THEN 1.0::DOUBLE / (k - 1) ELSE 0 END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS p FROM (SELECT unnest(range(1, 100000)) AS k)),
r AS MATERIALIZED (SELECT a.feature, a.id, any_value(a.x) AS x, list_extract(min(abs(b.x - a.x), 3), 3) AS r FROM l a JOIN l b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY a.feature, a.id),
m AS MATERIALIZED (SELECT r.feature, r.id, count(*) AS m FROM r JOIN l b ON r.feature = b.feature AND (abs(b.x - r.x) < r.r OR b.x = r.x) GROUP BY r.feature, r.id),
e AS (SELECT feature, avg(p) AS p FROM m JOIN psi q ON q.k = m.m GROUP BY feature)
SELECT feature, round(greatest(0, (SELECT p FROM psi WHERE k = (SELECT sum(c) FROM n)) + (SELECT p FROM psi WHERE k = 3) - (SELECT sum(c * p) / sum(c) FROM n JOIN psi ON k = c) - e.p), 6) AS mi FROM e""")
def neighbour_mi(spark, sf_dir):
    """Information of every component with the class, from the third nearest neighbours."""
    return neighbour_information(binary(spark, sf_dir), 64).select(F.col("feature").cast("long").alias("feature"), r6("mi").alias("mi"))


@query("""WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
b AS (SELECT event_type, least(15, greatest(0, floor((value - lo) / (hi - lo) * 16)))::BIGINT AS bin, count(*) AS n FROM events JOIN g USING (event_type) WHERE value IS NOT NULL GROUP BY ALL),
p AS (SELECT event_type, n / sum(n) OVER (PARTITION BY event_type) AS p FROM b)
SELECT event_type, round(sum(-p * ln(p)) / ln(16), 6) AS entropy FROM p GROUP BY event_type""")
def hist_entropy(spark, sf_dir):
    return N.histogram_entropy(read(spark, sf_dir, "events"), "value", 16, "event_type").withColumn("entropy", r6("entropy"))


@query()
def cluster_entropy(spark, sf_dir):
    return N.cluster_entropy(binary(spark, sf_dir), 4, 2).withColumn("ce", r6("ce"))


@query()
def forest_entropy(spark, sf_dir):
    return N.forest_entropy(binary(spark, sf_dir), 64).select("feature", r6("ce").alias("ce"))


@query(f"WITH {_ENERGY_K} SELECT layer, k, round(energy, 6) AS energy, CASE WHEN energy > 0.6 THEN 1 ELSE 0 END AS passed, CASE WHEN energy <= 0.6 AND energy > 0.3 THEN 1 ELSE 0 END AS kept FROM en")
def pick_channels(spark, sf_dir):
    rows = energies(spark, sf_dir)
    return rows.select("layer", "k").join(N.pick_channels(rows.withColumn("k", F.struct("layer", "k")), 0.6, 0.3).select("k.layer", "k.k", "energy", "passed", "kept"), ["layer", "k"]).withColumn("energy", r6("energy"))


@query()
def feature_importance(spark, sf_dir):
    return N.importances(binary(spark, sf_dir), trees=5, depth=4).withColumn("importance", r6("importance"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled(spark, sf_dir):
    return without(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), ["doc_id"])


@query(f"WITH {VX}, l AS (SELECT id, unnest(f) AS x FROM vx) SELECT id, round(max(x - m), 6) AS top FROM (SELECT id, x, avg(x) OVER (PARTITION BY id) AS m FROM l) GROUP BY id")
def remove_dc(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(F.array_max(subtract_mean(F.col("f")))).alias("top"))
