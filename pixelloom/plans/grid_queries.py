"""Queries of pixel filters, joins, neighbourhoods, selections, set and image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import vector as V
from pixelloom.operators import aggregates as A
from pixelloom.operators import filters as C
from pixelloom.operators import image as I
from pixelloom.operators import joins as J
from pixelloom.operators import sets as H
from pixelloom.operators import topk as G
from pixelloom.operators import windows as W
from pixelloom.plans.fixtures import AROUND, PX, RHO, SIDE, VX, costs, image_costs, images, pixels, read, vectors
from pixelloom.plans.registry import query
from pixelloom.plans.vector_queries import _ENERGY_K, energies, r6

# ---- filters ------------------------------------------------------------------------------------


@query(f"WITH {PX} SELECT image_id, count(*) FILTER (d <> 0) AS changed, count(*) FILTER (d = 0) AS unchanged FROM px GROUP BY image_id")
def changed_pixels(spark, sf_dir):
    px = pixels(spark, sf_dir)
    n = lambda rows, name: rows.groupBy("image_id").agg(F.count("*").alias(name))
    return n(C.changed(px), "changed").join(n(C.changed(px, keep=False), "unchanged"), "image_id")


@query(f"WITH {VX} SELECT id, 11::BIGINT AS n, round(f[1] + f[7] + f[13] + f[19] + f[25] + f[31] + f[37] + f[43] + f[49] + f[55] + f[61], 6) AS total FROM vx")
def energy_select(spark, sf_dir):
    kept = C.energetic_channels(vectors(spark, sf_dir), [1.0 if k % 6 == 0 else 0.0 for k in range(64)], 0.5)
    return kept.select("id", F.size("f").cast("long").alias("n"), r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {_ENERGY_K}, r AS (SELECT layer, k, energy, coalesce(sum(energy) OVER (PARTITION BY layer ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM en)
SELECT layer, k, round(energy, 6) AS energy FROM r WHERE before <= 3""")
def cum_energy_cut(spark, sf_dir):
    return C.cumulative_energy_cut(energies(spark, sf_dir), 3.0, "layer").select("layer", "k", r6("energy").alias("energy"))


@query(f"WITH {PX} SELECT image_id, pos AS ch, round(v, 6) AS v FROM px WHERE pos % 3 <> 0")
def mi_channels(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", F.col("pos").alias("ch"), "v")
    information = spark.range(64).select(F.col("id").alias("ch"), (F.col("id") % 3).cast("double").alias("mi"))
    return C.informative_channels(px, information).select("image_id", "ch", r6("v").alias("v"))


@query(f"WITH {PX} SELECT image_id, i, j, round(v, 6) AS v FROM px WHERE abs(v) >= 0.05")
def strong_targets(spark, sf_dir):
    return C.strong_targets(pixels(spark, sf_dir), "v").select("image_id", "i", "j", r6("v").alias("v"))


@query(f"""WITH {PX} SELECT image_id, i // 2 AS bi, j // 2 AS bj, round(stddev_pop(v), 6) AS deviation FROM px GROUP BY ALL HAVING stddev_pop(v) >= 0.02""")
def varied_patches(spark, sf_dir):
    kept = C.varied_patches(W.blocks(pixels(spark, sf_dir), 2), "f", 0.02)
    return kept.select("image_id", "bi", "bj", r6(V.std(F.col("f"))).alias("deviation"))


@query(f"""WITH {PX}, b AS (SELECT image_id, i // 4 AS bi, j // 4 AS bj, count(*) FILTER (d <> 0) AS n FROM px GROUP BY ALL)
SELECT image_id, bi, bj, n FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS total FROM b) WHERE n > total / 4""")
def busy_blocks(spark, sf_dir):
    return C.busy_blocks(pixels(spark, sf_dir), 4, 4)


@query(f"""WITH RECURSIVE {PX}, w AS (SELECT a.image_id, a.i, a.j, sum(b.d) AS n, any_value(c.d) AS d FROM px a JOIN px b ON a.image_id = b.image_id AND b.i BETWEEN a.i AND a.i + 3 AND b.j BETWEEN a.j AND a.j + 3
  JOIN px c ON c.image_id = a.image_id AND c.i = a.i + 2 AND c.j = a.j + 2 WHERE a.i <= 4 AND a.j <= 4 GROUP BY a.image_id, a.i, a.j),
r(image_id, p, free) AS (SELECT image_id, NULL::BIGINT, list(i * 8 + j ORDER BY i, j) FROM w WHERE n >= 0.15 * 16 AND d = 1 GROUP BY image_id
  UNION ALL SELECT image_id, free[1], list_filter(free[2:], lambda q: NOT (q // 8 BETWEEN free[1] // 8 - 2 AND free[1] // 8 + 1 AND q % 8 BETWEEN free[1] % 8 - 2 AND free[1] % 8 + 1)) FROM r WHERE len(free) > 0)
SELECT image_id, p // 8 AS i, p % 8 AS j FROM r WHERE p IS NOT NULL""")
def changed_windows(spark, sf_dir):
    """Windows of 4 x 4 with much change, in scan order."""
    maps = images(spark, sf_dir).select("image_id", "h", "w", F.expr("transform(px, (x, p) -> if((image_id * 7 + p * 13) % 5 = 0, 1D, 0D))").alias("diff"))
    return C.changed_windows(maps, 4, 0.15)


@query(f"""WITH {PX}, s AS (SELECT image_id, i, j FROM px WHERE v >= 0.2),
o AS (SELECT unnest(range(-1, 2)) AS a), n AS (SELECT DISTINCT image_id, i + x.a AS i, j + y.a AS j FROM s, o x, o y)
SELECT p.image_id, p.i, p.j, CASE WHEN p.v >= 0.2 OR (p.v >= 0.05 AND n.i IS NOT NULL) THEN 1 ELSE -1 END AS mark
FROM px p LEFT JOIN n ON p.image_id = n.image_id AND p.i = n.i AND p.j = n.j""")
def hysteresis_threshold(spark, sf_dir):
    return C.hysteresis(pixels(spark, sf_dir), 0.05, 0.2).select("image_id", "i", "j", "mark")


@query(f"WITH {PX} SELECT image_id, i, j, CASE WHEN v > 0.1 THEN 1 ELSE 0 END AS v FROM px")
def binarize(spark, sf_dir):
    return C.binarize(pixels(spark, sf_dir), 0.1).select("image_id", "i", "j", "v")


_TARGET = "CASE WHEN v > 0 AND d <> 0 THEN 1 WHEN v < -0.1 THEN -1 ELSE 0 END"


def _targets(spark, sf_dir):
    px = pixels(spark, sf_dir)
    planes = {"boundary": (F.col("v") > 0).cast("int"), "edge": F.col("d"), "authentic": (F.col("v") < -0.1).cast("int")}
    return C.boundary_targets(px.withColumns(planes))


@query(f"WITH {PX} SELECT image_id, i, j, {_TARGET} AS target FROM px")
def boundary_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("image_id", "i", "j", "target")


@query(f"""WITH {PX}, t AS (SELECT image_id, pos, {_TARGET} AS target FROM px), u AS (SELECT * FROM t WHERE target <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, target = 1 ORDER BY pos) AS r, count(*) FILTER (target = 1) OVER (PARTITION BY image_id) AS p FROM u)
SELECT image_id, pos, target FROM r WHERE target = 1 OR r <= p""")
def balance_negatives(spark, sf_dir):
    rows = _targets(spark, sf_dir).where("target <> 0").select("image_id", "pos", "target")
    return C.balance_negatives(rows, "pos", "target")


@query(f"WITH {PX} SELECT image_id, count(*) FILTER (v > -0.2 AND v < 0.2) AS inside, count(*) FILTER (NOT (v > -0.2 AND v < 0.2)) AS outside FROM px GROUP BY image_id")
def background_band(spark, sf_dir):
    a, b = C.background(pixels(spark, sf_dir), "v")
    both = H.stack(a.withColumn("inside", F.lit(1)), b.withColumn("inside", F.lit(0)))
    return both.groupBy("image_id").agg(F.sum("inside").alias("inside"), F.sum(1 - F.col("inside")).alias("outside"))


# ---- joins --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - o_totalprice, 4) AS difference FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pair_join(spark, sf_dir):
    cover = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_linenumber", "l_extendedprice")
    stego = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_totalprice")
    return J.pair(cover, stego).select(F.col("image_id").alias("l_orderkey"), "l_linenumber", F.round(F.col("l_extendedprice") - F.col("o_totalprice"), 4).alias("difference"))


@query("SELECT p_partkey AS name, round(p_retailprice, 2) AS rho FROM part")
def rho_join(spark, sf_dir):
    parts = read(spark, sf_dir, "part")
    maps = parts.select(F.concat("p_partkey", F.lit(".mat")).alias("file"), F.round("p_retailprice", 2).alias("rho"))
    return J.with_costs(parts.select(F.col("p_partkey").alias("name")), maps)


@query(f"WITH {PX} SELECT image_id, i, j, round(v, 6) AS v FROM px WHERE d <> 0 AND i < 4")
def position_semi(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return J.at_positions(px, px.where("d <> 0 AND i < 4")).select("image_id", "i", "j", r6("v").alias("v"))


@query(f"WITH {PX} SELECT image_id, sum(d)::BIGINT AS changed, round(sum(v * d), 6) AS total FROM px GROUP BY image_id")
def diff_context_join(spark, sf_dir):
    px = pixels(spark, sf_dir)
    context, diff = px.select("image_id", "i", "j", "v"), px.select("image_id", "i", "j", "d")
    both = context.join(diff, ["image_id", "i", "j"])
    return both.groupBy("image_id").agg(F.sum("d").alias("changed"), r6(F.sum(F.col("v") * F.col("d"))).alias("total"))


@query(f"""WITH {PX}, c AS (SELECT image_id, i // 2 AS i, j // 2 AS j, max(v) AS m FROM px GROUP BY ALL)
SELECT p.image_id, p.i, p.j, round(p.v, 6) AS v, round(c.m, 6) AS m FROM px p JOIN c ON p.image_id = c.image_id AND p.i // 2 = c.i AND p.j // 2 = c.j""")
def upsample_join(spark, sf_dir):
    px = pixels(spark, sf_dir).select("image_id", "i", "j", "v")
    return J.with_coarse(px, A.block_pool(px).withColumnRenamed("v", "m"), 2).select("image_id", "i", "j", r6("v").alias("v"), r6("m").alias("m"))


_CENTRES = "c AS (SELECT label AS centroid, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS pos, unnest(f) AS x FROM vx) GROUP BY label, pos) GROUP BY label)"


@query(f"""WITH {VX}, {_CENTRES}, n AS (SELECT id, centroid, list_distance(f, c) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), centroid) AS r FROM vx, c)
SELECT id, centroid, round(d, 6) AS distance FROM n WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return J.nearest_centroid(rows, A.class_means(rows, 64)).select("id", "centroid", r6("distance").alias("distance"))


@query(f"""WITH {VX}, {_CENTRES}, n AS (SELECT id, centroid, list_distance(f, c) AS d, row_number() OVER (PARTITION BY id ORDER BY list_distance(f, c), centroid) AS r FROM vx, c),
w AS (SELECT id, centroid % 2 AS class, sum(exp(-d)) AS w FROM n WHERE r <= 3 GROUP BY ALL)
SELECT id, class, round(w / sum(w) OVER (PARTITION BY id), 6) AS share FROM w""")
def knn_vote(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centres = A.class_means(rows, 64).withColumn("class", F.col("centroid") % 2)
    return J.centroid_vote(rows, centres, 3).select("id", "class", r6("share").alias("share"))


@query(f"""WITH {AROUND} SELECT image_id, i, j, round(sum(v), 6) AS total, round(max(CASE WHEN n = 1 THEN v END), 6) AS nw, round(max(CASE WHEN n = 8 THEN v END), 6) AS se FROM around GROUP BY image_id, i, j""")
def neighbor3x3_reflect(spark, sf_dir):
    near = J.surround_in_images(images(spark, sf_dir), SIDE, SIDE)
    return near.select("image_id", "i", "j", r6(V.total(F.col("around"))).alias("total"), r6(F.get("around", F.lit(1))).alias("nw"), r6(F.get("around", F.lit(8))).alias("se"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def anti_files(spark, sf_dir):
    big = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.without(read(spark, sf_dir, "orders").select("o_orderkey"), big, ["o_orderkey"])


@query(f"WITH {PX} SELECT image_id, i, j, CASE WHEN v > 0 THEN 1 ELSE 0 END AS prediction FROM px WHERE d <> 0")
def place_predictions(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumn("sample_id", F.col("image_id") * 64 + F.col("pos"))
    predictions = C.changed(px).select("sample_id", V.sign_label(F.col("v")).alias("prediction"))
    return J.place_predictions(px.select("sample_id", "image_id", "i", "j"), predictions).select("image_id", "i", "j", "prediction")


# ---- neighbourhoods -----------------------------------------------------------------------------


@query(f"""WITH {PX}, o AS (SELECT unnest(range(-1, 2)) AS a), w AS (SELECT image_id, i, j, least(7, greatest(0, i + x.a)) AS si, least(7, greatest(0, j + y.a)) AS sj, (x.a + 1) * 3 + y.a + 1 AS n FROM px, o x, o y)
SELECT w.image_id, w.i, w.j, round(sum(p.v * (n + 1)), 6) AS weighted FROM w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj GROUP BY w.image_id, w.i, w.j""")
def gather_windows(spark, sf_dir):
    """3 x 3 windows, the edge repeated; weights tell the places apart."""
    rows = W.features_of(W.gather(images(spark, sf_dir), 3))
    return rows.select("image_id", "i", "j", r6(F.expr("aggregate(zip_with(f, sequence(1, 9), (x, n) -> x * n), 0D, (s, x) -> s + x)")).alias("weighted"))


@query(f"""WITH {PX}, m AS (SELECT image_id, i // 2 AS i, j // 2 AS j, max(v) AS v FROM px GROUP BY ALL), o AS (SELECT unnest(range(-1, 2)) AS a),
w AS (SELECT image_id, i, j, least(3, greatest(0, i + x.a)) AS si, least(3, greatest(0, j + y.a)) AS sj FROM m, o x, o y)
SELECT w.image_id, w.i, w.j, round(sum(m.v), 6) AS total FROM w JOIN m ON m.image_id = w.image_id AND m.i = w.si AND m.j = w.sj GROUP BY w.image_id, w.i, w.j""")
def pool_then_gather(spark, sf_dir):
    rows = W.features_of(W.gather(images(spark, sf_dir), 3, pool_first="max"))
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {PX}, o AS (SELECT unnest(range(-1, 2)) AS a), w AS (SELECT image_id, i, j, least(7, greatest(0, i + x.a)) AS si, least(7, greatest(0, j + y.a)) AS sj FROM px, o x, o y),
s AS (SELECT w.image_id, w.i, w.j, sum(p.v) AS t FROM w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj GROUP BY w.image_id, w.i, w.j)
SELECT image_id, i // 2 AS i, j // 2 AS j, round(avg(t), 6) AS total FROM s GROUP BY ALL""")
def gather_then_pool(spark, sf_dir):
    rows = W.features_of(W.gather(images(spark, sf_dir), 3, pool_after="avg"))
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"))


@query(f"WITH {PX} SELECT image_id, i, j, round(v, 6) AS v FROM px")
def gather_inverse(spark, sf_dir):
    """Windows that don't overlap, and back."""
    back = W.ungather(W.gather(images(spark, sf_dir), 2, None, stride=2), 2)
    return W.features_of(back).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("v"))


@query(f"""WITH {PX}, o AS (SELECT unnest([-2, 0, 2]) AS a), r AS (SELECT image_id, i, j, i + x.a AS si, j + y.a AS sj FROM px, o x, o y),
w AS (SELECT image_id, i, j, CASE WHEN si < 0 THEN -si WHEN si > 7 THEN 14 - si ELSE si END AS si, CASE WHEN sj < 0 THEN -sj WHEN sj > 7 THEN 14 - sj ELSE sj END AS sj FROM r)
SELECT w.image_id, w.i, w.j, round(sum(p.v), 6) AS total, round(any_value(q.v), 6) AS centre FROM w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj
JOIN px q ON q.image_id = w.image_id AND q.i = w.i AND q.j = w.j GROUP BY w.image_id, w.i, w.j""")
def dilated_neighbours(spark, sf_dir):
    rows = W.features_of(W.neighbours(images(spark, sf_dir), 1, 2))
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"), r6(F.element_at("f", -1)).alias("centre"))


@query(f"""WITH {PX}, c AS (SELECT image_id, i, j FROM px WHERE i % 3 = 0 AND j % 3 = 0 AND i < 6 AND j < 6)
SELECT c.image_id, c.i // 3 AS i, c.j // 3 AS j, round(sum(p.v), 6) AS total FROM c JOIN px p ON p.image_id = c.image_id AND p.i BETWEEN c.i AND c.i + 2 AND p.j BETWEEN c.j AND c.j + 2 GROUP BY ALL""")
def strided_patches(spark, sf_dir):
    rows = W.features_of(W.patches(images(spark, sf_dir), 3, 3))
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {PX}, o AS (SELECT unnest([-2, 0, 2]) AS a), r AS (SELECT image_id, i, j, i + x.a AS si, j + y.a AS sj FROM px, o x, o y),
w AS (SELECT image_id, i, j, CASE WHEN si < 0 THEN -si - 1 WHEN si > 7 THEN 15 - si ELSE si END AS si, CASE WHEN sj < 0 THEN -sj - 1 WHEN sj > 7 THEN 15 - sj ELSE sj END AS sj FROM r)
SELECT w.image_id, w.i, w.j, round(sum(p.v), 6) AS total FROM w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj GROUP BY w.image_id, w.i, w.j""")
def dilated_points(spark, sf_dir):
    rows = W.features_of(W.dilated_points(images(spark, sf_dir), 2))
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {AROUND} SELECT image_id, i, j, round(max(v), 6) AS largest, round(min(v), 6) AS smallest, round(avg(v), 6) AS mean FROM around GROUP BY image_id, i, j""")
def neighbour_aggregate(spark, sf_dir):
    rows = W.features_of(W.aggregate_neighbours(images(spark, sf_dir)))
    return rows.select("image_id", "i", "j", *[r6(F.get("f", F.lit(k + 1))).alias(n) for k, n in enumerate(("largest", "smallest", "mean"))])


@query(f"WITH {PX} SELECT image_id, i // 4 AS bi, j // 4 AS bj, 16::BIGINT AS n, round(sum(v), 6) AS total FROM px GROUP BY ALL")
def blocks(spark, sf_dir):
    return W.blocks(pixels(spark, sf_dir), 4).select("image_id", "bi", "bj", F.size("f").cast("long").alias("n"), r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {PX}, c AS (SELECT image_id, i, j FROM px WHERE d <> 0 AND i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6)
SELECT c.image_id, c.i, c.j, round(sum(p.v), 6) AS total FROM c JOIN px p ON p.image_id = c.image_id AND p.i BETWEEN c.i - 1 AND c.i + 1 AND p.j BETWEEN c.j - 1 AND c.j + 1 GROUP BY ALL""")
def centred_patches(spark, sf_dir):
    rows = W.centred_patches(images(spark, sf_dir), C.changed(pixels(spark, sf_dir)), 3)
    return rows.select("image_id", "i", "j", r6(V.total(F.col("f"))).alias("total"))


@query(f"""WITH {PX} SELECT image_id, ((i - 1) // 4) * 2 + (j - 1) // 4 AS tile, (i - 1) % 4 AS i, (j - 1) % 4 AS j, round(v, 6) AS v FROM px
WHERE i >= 1 AND (i - 1) % 4 < 3 AND (i - 1) // 4 < 2 AND j >= 1 AND (j - 1) % 4 < 3 AND (j - 1) // 4 < 2""")
def tile_patches(spark, sf_dir):
    return W.tiles(pixels(spark, sf_dir), 1, 4, 3, 2).select("image_id", "tile", "i", "j", r6("v").alias("v"))


def _change_maps(spark, sf_dir):
    return images(spark, sf_dir).withColumn("px", F.expr("transform(px, (x, p) -> if((image_id * 7 + p * 13) % 5 = 0, 1D, 0D))"))


@query(f"""WITH RECURSIVE {PX}, r(image_id, p, free) AS (SELECT image_id, NULL::BIGINT, list(pos ORDER BY pos) FROM px WHERE d = 1 GROUP BY image_id
  UNION ALL SELECT image_id, free[1], list_filter(free, lambda q: abs(q // 8 - free[1] // 8) > 2 OR abs(q % 8 - free[1] % 8) > 2) FROM r WHERE len(free) > 0)
SELECT image_id, p // 8 AS i, p % 8 AS j FROM r WHERE p IS NOT NULL""")
def thin_changes(spark, sf_dir):
    """Greedy thinning in raster order."""
    rows = W.features_of(W.thin(_change_maps(spark, sf_dir), 2))
    return rows.where("f[0] <> 0").select("image_id", "i", "j")


@query(f"""WITH RECURSIVE {PX}, r(image_id, p, px, seen) AS (SELECT image_id, 0, list(d ORDER BY pos), list(0 ORDER BY pos) FROM px GROUP BY image_id
  UNION ALL SELECT image_id, p + 1, CASE WHEN hit THEN list_transform(px, lambda x, q: CASE WHEN abs((q - 1) // 8 - p // 8) <= 1 AND abs((q - 1) % 8 - p % 8) <= 1 THEN 1 - x ELSE x END) ELSE px END,
  CASE WHEN hit THEN list_transform(seen, lambda x, q: CASE WHEN abs((q - 1) // 8 - p // 8) <= 1 AND abs((q - 1) % 8 - p % 8) <= 1 THEN 1 ELSE x END) ELSE seen END
  FROM (SELECT *, px[p + 1] <> 0 AND seen[p + 1] = 0 AS hit FROM r) WHERE p < 64)
SELECT image_id, q // 8 AS i, q % 8 AS j FROM (SELECT image_id, unnest(range(64)) AS q, unnest(px) AS d FROM r WHERE p = 64) WHERE d <> 0""")
def hard_ring(spark, sf_dir):
    rows = W.features_of(W.hard_ring(_change_maps(spark, sf_dir), 1))
    return rows.where("f[0] <> 0").select("image_id", "i", "j")


@query(f"WITH {_ENERGY_K} SELECT layer, k, round(sum(energy) OVER (PARTITION BY layer ORDER BY k), 6) AS running FROM en")
def running_energy(spark, sf_dir):
    return W.running_energy(energies(spark, sf_dir), "layer").select("layer", "k", r6("running").alias("running"))


@query(f"""WITH {PX}, z(i, j, g) AS (VALUES (0,0,0),(0,1,1),(1,0,2),(2,0,3),(1,1,4),(0,2,5),(0,3,6),(1,2,7),(2,1,8),(3,0,9),(3,1,10),(2,2,11),(1,3,12),(2,3,13),(3,2,14),(3,3,15))
SELECT z.g::BIGINT AS "group", count(*) AS n, round(sum(v), 4) AS total FROM px p JOIN z ON p.i % 4 = z.i AND p.j % 4 = z.j GROUP BY z.g""")
def zigzag_groups(spark, sf_dir):
    rows = W.zigzag_groups(pixels(spark, sf_dir), 4)
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("total"))


@query(f"WITH {PX} SELECT image_id, i // 2 AS i, j // 2 AS j, round(v, 6) AS v FROM px WHERE i % 2 = 0 AND j % 2 = 0")
def subsample(spark, sf_dir):
    return W.subsample(pixels(spark, sf_dir)).select("image_id", "i", "j", r6("v").alias("v"))


# ---- selections and sets ------------------------------------------------------------------------


@query(f"""WITH {RHO}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rho, i, j) AS rank FROM rho),
t AS (SELECT image_id, sum(d) AS total FROM rho GROUP BY image_id)
SELECT image_id, sum(d)::BIGINT AS hits, round(avg(d), 6) AS precision, round(sum(d) / any_value(total), 6) AS recall FROM k JOIN t USING (image_id) WHERE rank <= 6 GROUP BY image_id""")
def roi_query(spark, sf_dir):
    """Flagship: which changes the six cheapest pixels of every image hold."""
    rows = G.lowest_cost_in_images(image_costs(spark, sf_dir), 6)
    hits, every = F.expr("aggregate(roi, 0L, (s, x) -> s + x.d)"), F.expr("aggregate(costs, 0L, (s, x) -> s + x.d)")
    return rows.select("image_id", hits.alias("hits"), r6(hits / F.size("roi")).alias("precision"), r6(hits / every).alias("recall"))


@query(f"WITH {RHO} SELECT image_id, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rho, i, j)::INT AS rank FROM rho) WHERE rank <= 4")
def roi_topk(spark, sf_dir):
    return G.lowest_cost(costs(spark, sf_dir), 4).select("image_id", "i", "j", "rank")


@query(f"""WITH {RHO}, k AS (SELECT image_id, row_number() OVER w AS n, sum(d) OVER w AS hits, sum(d) OVER (PARTITION BY image_id) AS total FROM rho WINDOW w AS (PARTITION BY image_id ORDER BY rho, i, j ROWS UNBOUNDED PRECEDING))
SELECT image_id, n, round(hits / n, 6) AS precision, round(hits / total, 6) AS recall FROM k WHERE n IN (1, 3, 6, 12, 24, 48)""")
def roi_sweep(spark, sf_dir):
    rows = G.region_sweep_in_images(image_costs(spark, sf_dir), [1, 3, 6, 12, 24, 48])
    return rows.select("image_id", "n", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("SELECT p_partkey || '.pgm' AS name, p_partkey AS number FROM part")
def numeric_name_sort(spark, sf_dir):
    return G.by_number_in_name(read(spark, sf_dir, "part").select(F.concat("p_partkey", F.lit(".pgm")).alias("name")))


@query(f"WITH {_ENERGY_K} SELECT layer, k, round(energy, 6) AS energy FROM (SELECT *, row_number() OVER (ORDER BY energy DESC, k, layer) AS r FROM en) WHERE r <= 7")
def eigen_order(spark, sf_dir):
    rows = energies(spark, sf_dir).withColumn("k", F.struct("k", "layer"))
    return G.eigen_order(rows, 7).select("layer", "k.k", r6("energy").alias("energy"))


@query("SELECT s_suppkey AS feature, round(s_acctbal, 2) AS ce FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 5")
def best_features(spark, sf_dir):
    scores = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("feature"), F.col("s_acctbal").alias("ce"))
    return G.best_features(scores, 5).select("feature", F.round("ce", 2).alias("ce"))


@query(f"WITH {VX}, d AS (SELECT id, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS d FROM vx) SELECT id, round(d, 6) AS distance FROM d ORDER BY d DESC, id LIMIT 9")
def farthest(spark, sf_dir):
    return G.farthest(vectors(spark, sf_dir), [0.0] * 64, 9).select("id", r6("distance").alias("distance"))


@query(f"""WITH RECURSIVE {PX}, r(image_id, pick, p, free) AS (SELECT image_id, -1::BIGINT, NULL::BIGINT, list(pos ORDER BY v DESC, pos) FROM px GROUP BY image_id
  UNION ALL SELECT image_id, pick + 1, free[1], list_filter(free, lambda q: abs(q // 8 - free[1] // 8) > 1 OR abs(q % 8 - free[1] % 8) > 1) FROM r WHERE len(free) > 0 AND pick < 3)
SELECT image_id, pick, p // 8 AS i, p % 8 AS j FROM r WHERE p IS NOT NULL""")
def separated_extremes(spark, sf_dir):
    """Largest pixels, each clearing its neighbourhood."""
    return G.separated_extremes(images(spark, sf_dir), 4, 1)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def first_n(spark, sf_dir):
    return G.first_n(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 20, "o_orderdate", "o_orderkey")


@query("SELECT doc_id AS sample_id, lang FROM documents")
def order_restored(spark, sf_dir):
    return G.restored(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "lang"))


@query("SELECT n_nationkey::BIGINT AS key, 'nation' AS kind FROM nation UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT r_regionkey, 'region' FROM region")
def stack(spark, sf_dir):
    one = lambda t, k: read(spark, sf_dir, t).select(F.col(k).cast("long").alias("key"), F.lit(t).alias("kind"))
    return H.stack(one("nation", "n_nationkey"), one("supplier", "s_suppkey"), one("region", "r_regionkey"))


_LEAVES = "a AS (SELECT image_id, i, j, pos % 3 AS leaf FROM px), b AS (SELECT image_id, i, j, (pos + CASE WHEN d <> 0 THEN 1 ELSE 0 END) % 3 AS leaf FROM px)"


@query(f"""WITH {PX}, {_LEAVES} SELECT leaf, 'left' AS side, image_id, i, j FROM (SELECT leaf, image_id, i, j FROM a EXCEPT SELECT leaf, image_id, i, j FROM b)
UNION ALL SELECT leaf, 'entered', image_id, i, j FROM (SELECT leaf, image_id, i, j FROM b EXCEPT SELECT leaf, image_id, i, j FROM a)""")
def leaf_diff(spark, sf_dir):
    px = pixels(spark, sf_dir)
    a = px.select((F.col("pos") % 3).alias("leaf"), "image_id", "i", "j")
    b = px.select(((F.col("pos") + (F.col("d") != 0).cast("int")) % 3).alias("leaf"), "image_id", "i", "j")
    return H.leaf_changes(a, b)


@query("""SELECT count(*) AS n, count(*) = (SELECT count(*) FROM documents) AS complete FROM (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1)""")
def coverage(spark, sf_dir):
    labels = read(spark, sf_dir, "labels")
    total = read(spark, sf_dir, "documents").count()
    return H.covered(total, labels.where("quality = 1").select("doc_id"), labels.where("toxic = 1").select("doc_id"))


@query(f"WITH {PX} SELECT image_id, i, j, CASE WHEN v > 0 AND d <> 0 THEN 1 ELSE 0 END AS hit FROM px")
def mask_and(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "i", "j", H.both(F.col("v") > 0, F.col("d") != 0).alias("hit"))


@query("SELECT p_partkey, (p_size - (p_size + 1) // 2)::BIGINT AS leaves FROM part".replace("(p_size + 1) // 2", "(p_size + 2) // 3"))
def leaf_channels(spark, sf_dir):
    every, passed = F.expr("sequence(0, p_size - 1)"), F.expr("sequence(0, p_size - 1, 3)")
    return read(spark, sf_dir, "part").select("p_partkey", F.size(H.leaf_channels(every, passed)).cast("long").alias("leaves"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def delete_rows(spark, sf_dir):
    return H.delete_rows(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


# ---- images -------------------------------------------------------------------------------------


@query(f"""WITH {PX}, o AS (SELECT unnest(range(-1, 2)) AS a), w AS (SELECT image_id, i, j, x.a AS a, y.a AS b, least(7, greatest(0, i + x.a)) AS si, least(7, greatest(0, j + y.a)) AS sj FROM px, o x, o y),
g AS (SELECT w.image_id, w.i, w.j, sum(p.v * b * CASE WHEN a = 0 THEN 2 ELSE 1 END) AS gx, sum(p.v * a * CASE WHEN b = 0 THEN 2 ELSE 1 END) AS gy
FROM w JOIN px p ON p.image_id = w.image_id AND p.i = w.si AND p.j = w.sj GROUP BY w.image_id, w.i, w.j)
SELECT image_id, i, j, round(sqrt(gx * gx + gy * gy) / max(sqrt(gx * gx + gy * gy)) OVER (PARTITION BY image_id), 6) AS g FROM g""")
def sobel(spark, sf_dir):
    rows = W.features_of(I.sobel(images(spark, sf_dir)))
    return rows.select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("g"))


_ROBERTS = f"""WITH {PX} SELECT a.image_id, a.i, a.j, round(CASE WHEN a.i = 7 OR a.j = 7 THEN a.v ELSE abs(b.v - a.v) + abs(c.v - e.v) END, 6) AS g FROM px a
LEFT JOIN px b ON a.image_id = b.image_id AND b.i = a.i + 1 AND b.j = a.j + 1 LEFT JOIN px c ON a.image_id = c.image_id AND c.i = a.i + 1 AND c.j = a.j
LEFT JOIN px e ON a.image_id = e.image_id AND e.i = a.i AND e.j = a.j + 1"""


@query(_ROBERTS)
def roberts_edges(spark, sf_dir):
    rows = W.features_of(I.roberts(images(spark, sf_dir), in_place=False))
    return rows.select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("g"))


@query(_ROBERTS)
def roberts_in_place(spark, sf_dir):
    return W.features_of(I.roberts(images(spark, sf_dir))).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("g"))


@query(f"""WITH {PX}, u AS (SELECT image_id, i, j, floor((v + 1) * 100) AS v FROM px), o AS (SELECT unnest(range(-1, 2)) AS a),
k AS (SELECT x.a AS a, y.a AS b, CASE WHEN x.a = 0 AND y.a = 0 THEN -4 WHEN x.a = 0 OR y.a = 0 THEN 2 ELSE -1 END / 4.0::DOUBLE AS k1, CASE WHEN x.a <> 0 THEN 0 WHEN y.a = 0 THEN -1 ELSE 0.5 END::DOUBLE AS k3 FROM o x, o y),
w AS (SELECT image_id, i, j, k1, k3, least(7, greatest(0, i + a)) AS si, least(7, greatest(0, j + b)) AS sj FROM u, k),
s AS (SELECT w.image_id, w.i, w.j, sum(u.v * k1) AS r1, sum(u.v * k3) AS r3 FROM w JOIN u ON u.image_id = w.image_id AND u.i = w.si AND u.j = w.sj GROUP BY w.image_id, w.i, w.j)
SELECT image_id, i, j, round_even(greatest(-2, least(2, r1)), 0) AS r1, round_even(greatest(-2, least(2, r3)), 0) AS r3 FROM s""")
def residual_maps(spark, sf_dir):
    whole = images(spark, sf_dir).withColumn("px", F.expr("transform(px, x -> cast(floor((x + 1) * 100) as double))"))
    rows = W.features_of(I.residual_maps(whole))
    # + 0.0 turns a negative zero into zero
    return rows.select("image_id", "i", "j", (F.get("f", F.lit(0)) + 0.0).alias("r1"), (F.get("f", F.lit(2)) + 0.0).alias("r3"))


#: A blurred image: Gaussian of deviation 1, radius 4, mirrored borders.
_BLUR = PX + """,
gk AS (SELECT a, exp(-a * a / 2.0) / (SELECT sum(exp(-b * b / 2.0)) FROM (SELECT unnest(range(-4, 5)) AS b)) AS w FROM (SELECT unnest(range(-4, 5)) AS a)),
g1 AS MATERIALIZED (SELECT t.image_id, t.i, t.j, sum(p.v * k.w) AS v FROM px t, gk k, px p WHERE p.image_id = t.image_id AND p.j = t.j AND p.i = CASE WHEN t.i + k.a < 0 THEN -1 - t.i - k.a WHEN t.i + k.a > 7 THEN 15 - t.i - k.a ELSE t.i + k.a END GROUP BY ALL),
blur AS MATERIALIZED (SELECT t.image_id, t.i, t.j, sum(p.v * k.w) AS v FROM g1 t, gk k, g1 p WHERE p.image_id = t.image_id AND p.i = t.i AND p.j = CASE WHEN t.j + k.a < 0 THEN -1 - t.j - k.a WHEN t.j + k.a > 7 THEN 15 - t.j - k.a ELSE t.j + k.a END GROUP BY ALL)"""
#: From grad(image_id, i, j, gx, gy): inner pixels that no neighbour along the gradient exceeds.
_RIDGE = """m AS MATERIALIZED (SELECT image_id, i, j, sqrt(gx * gx + gy * gy) AS g, degrees(atan2(gy, gx)) AS deg FROM grad),
q AS (SELECT *, round_even((deg - 180 * floor(deg / 180)) / 45, 0)::INT % 4 AS s FROM m WHERE i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6),
d(s, a, b) AS (VALUES (0, 0, 1), (1, 1, -1), (2, 1, 0), (3, 1, 1)),
ridge AS MATERIALIZED (SELECT q.image_id, q.i, q.j, q.g FROM q JOIN d USING (s) JOIN m x ON x.image_id = q.image_id AND x.i = q.i + a AND x.j = q.j + b JOIN m y ON y.image_id = q.image_id AND y.i = q.i - a AND y.j = q.j - b
  WHERE q.g >= x.g AND q.g >= y.g)"""


@query(f"WITH {_BLUR} SELECT image_id, i, j, round(v, 6) AS v FROM blur")
def gaussian_targets(spark, sf_dir):
    return W.features_of(I.gaussian(images(spark, sf_dir))).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("v"))


@query(f"""WITH {PX} SELECT a.image_id, a.i, a.j, round(greatest(max(b.v), CASE WHEN a.i IN (0, 7) OR a.j IN (0, 7) THEN max(b.v) ELSE max(b.v) END), 6) AS v FROM px a
JOIN px b ON a.image_id = b.image_id AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.image_id, a.i, a.j""")
def dilate(spark, sf_dir):
    return I.dilate_pixels(pixels(spark, sf_dir), SIDE, SIDE).select("image_id", "i", "j", r6("v").alias("v"))


@query(f"""WITH {_BLUR}, o AS (SELECT unnest(range(-1, 2)) AS a),
grad AS MATERIALIZED (SELECT t.image_id, t.i, t.j, sum(p.v * y.a * CASE WHEN x.a = 0 THEN 2 ELSE 1 END) AS gx, sum(p.v * x.a * CASE WHEN y.a = 0 THEN 2 ELSE 1 END) AS gy FROM blur t, o x, o y, blur p
  WHERE p.image_id = t.image_id AND p.i = least(7, greatest(0, t.i + x.a)) AND p.j = least(7, greatest(0, t.j + y.a)) GROUP BY t.image_id, t.i, t.j),
{_RIDGE} SELECT DISTINCT r.image_id, r.i, r.j FROM ridge r JOIN ridge n ON r.image_id = n.image_id AND abs(r.i - n.i) <= 1 AND abs(r.j - n.j) <= 1 WHERE r.g >= 0.05 AND n.g >= 0.2""")
def canny_edges(spark, sf_dir):
    rows = W.features_of(I.canny(images(spark, sf_dir), 0.05, 0.2))
    return rows.where("f[0] > 0").select("image_id", "i", "j")


@query(f"""WITH {PX}, grad AS (SELECT p.image_id, p.i, p.j, (r.v - l.v) / (r.j - l.j) AS gx, (b.v - t.v) / (b.i - t.i) AS gy FROM px p
  JOIN px l ON l.image_id = p.image_id AND l.i = p.i AND l.j = greatest(0, p.j - 1) JOIN px r ON r.image_id = p.image_id AND r.i = p.i AND r.j = least(7, p.j + 1)
  JOIN px t ON t.image_id = p.image_id AND t.j = p.j AND t.i = greatest(0, p.i - 1) JOIN px b ON b.image_id = p.image_id AND b.j = p.j AND b.i = least(7, p.i + 1)),
{_RIDGE} SELECT image_id, i, j, round(g, 6) AS g FROM ridge WHERE g > 0""")
def thin_edges(spark, sf_dir):
    rows = W.features_of(I.thin_edges(images(spark, sf_dir)))
    return rows.where("f[0] > 0").select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("g"))


@query(f"WITH {PX} SELECT image_id, 2 * i + a AS i, 2 * j + b AS j, round(v, 6) AS v FROM px, (SELECT unnest(range(2)) AS a) x, (SELECT unnest(range(2)) AS b) y")
def resize_nearest(spark, sf_dir):
    return W.features_of(I.resize(images(spark, sf_dir), 16, 16)).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("v"))


@query(f"""WITH {PX}, n AS (SELECT k, floor(p)::INT AS lo, least(7, floor(p)::INT + 1) AS hi, p - floor(p) AS f FROM (SELECT k, least(7, greatest(0, (k + 0.5) * 8 / 12 - 0.5)) AS p FROM (SELECT unnest(range(12)) AS k)))
SELECT a.image_id, y.k AS i, x.k AS j, round((a.v * (1 - y.f) + c.v * y.f) * (1 - x.f) + (b.v * (1 - y.f) + e.v * y.f) * x.f, 6) AS v FROM n y, n x JOIN px a ON a.i = y.lo AND a.j = x.lo
JOIN px b ON b.image_id = a.image_id AND b.i = y.lo AND b.j = x.hi JOIN px c ON c.image_id = a.image_id AND c.i = y.hi AND c.j = x.lo JOIN px e ON e.image_id = a.image_id AND e.i = y.hi AND e.j = x.hi""")
def resize_bilinear(spark, sf_dir):
    return W.features_of(I.resize(images(spark, sf_dir), 12, 12, "bilinear")).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("v"))


@query(f"WITH {PX} SELECT image_id, 'rotate' AS how, j AS i, 7 - i AS j, round(v, 6) AS v FROM px UNION ALL SELECT image_id, 'flip', i, 7 - j, round(v, 6) FROM px")
def flip_rotate(spark, sf_dir):
    px = pixels(spark, sf_dir)
    both = [I.turn_pixels(px, SIDE, SIDE, how).withColumn("how", F.lit(how)) for how in ("rotate", "flip")]
    return H.stack(*both).select("image_id", "how", "i", "j", r6("v").alias("v"))


@query(f"""WITH {PX}, n AS (SELECT unnest(range(10)) AS i), g AS (SELECT image_id, x.i AS i, y.i AS j FROM (SELECT DISTINCT image_id FROM px), n x, n y)
SELECT g.image_id, g.i, g.j, round(p.v, 6) AS v FROM g JOIN px p ON p.image_id = g.image_id AND p.i = least(7, greatest(0, g.i - 1)) AND p.j = least(7, greatest(0, g.j - 1))""")
def bordered(spark, sf_dir):
    return W.features_of(I.bordered(images(spark, sf_dir), 1)).select("image_id", "i", "j", r6(F.get("f", F.lit(0))).alias("v"))


@query()
def wavelet_cost(spark, sf_dir):
    rows = W.features_of(I.wavelet_cost(images(spark, sf_dir)))
    return rows.select("image_id", "i", "j", F.round(F.get("f", F.lit(0)), 4).alias("rho"))


@query()
def orientation_descriptors(spark, sf_dir):
    rows = I.orientation_descriptors(images(spark, sf_dir), 8)
    return rows.select("image_id", "bi", "bj", F.size("f").alias("n"), r6(V.norm(F.col("f"))).alias("norm"))


@query(f"""WITH {PX}, sk AS (SELECT a, exp(-a * a / 2 / 2.31) AS w FROM (SELECT unnest(range(-6, 7)) AS a)), sg AS (SELECT a, w / (SELECT sum(w) FROM sk) AS w FROM sk),
s1 AS MATERIALIZED (SELECT t.image_id, t.i, t.j, sum(p.v * k.w) AS v FROM px t, sg k JOIN px p ON p.image_id = t.image_id AND p.j = t.j AND p.i = CASE WHEN t.i + k.a < 0 THEN -1 - t.i - k.a WHEN t.i + k.a > 7 THEN 15 - t.i - k.a ELSE t.i + k.a END GROUP BY ALL),
s2 AS MATERIALIZED (SELECT t.image_id, t.i, t.j, sum(p.v * k.w) AS v FROM s1 t, sg k JOIN s1 p ON p.image_id = t.image_id AND p.i = t.i AND p.j = CASE WHEN t.j + k.a < 0 THEN -1 - t.j - k.a WHEN t.j + k.a > 7 THEN 15 - t.j - k.a ELSE t.j + k.a END GROUP BY ALL),
gr AS (SELECT c.image_id, c.i, c.j, r.v - l.v AS gx, t.v - b.v AS gy FROM s2 c JOIN s2 l ON l.image_id = c.image_id AND l.i = c.i AND l.j = c.j - 1 JOIN s2 r ON r.image_id = c.image_id AND r.i = c.i AND r.j = c.j + 1
  JOIN s2 t ON t.image_id = c.image_id AND t.i = c.i - 1 AND t.j = c.j JOIN s2 b ON b.image_id = c.image_id AND b.i = c.i + 1 AND b.j = c.j),
po AS (SELECT image_id, i, j, sqrt(gx * gx + gy * gy) AS g, atan2(gy, gx) / (2 * pi()) * 8 AS o FROM gr), pt AS (SELECT image_id, i, j, g, o - 8 * floor(o / 8) AS o FROM po),
kp AS (SELECT x.k AS bi, y.k AS bj FROM (SELECT unnest(range(2)) AS k) x, (SELECT unnest(range(2)) AS k) y),
sh AS (SELECT image_id, bi, bj, g * exp(-(r * r + c * c) / 8) AS g, r + 1.5 AS r, c + 1.5 AS c, o FROM (SELECT *, (i - bi * 4 - 2) / 6.0::DOUBLE AS r, (j - bj * 4 - 2) / 6.0::DOUBLE AS c FROM pt, kp)),
ce AS (SELECT unnest(range(128)) AS n), hs AS (SELECT image_id, bi, bj, n, sum(g * greatest(0, 1 - abs(r - n // 32)) * greatest(0, 1 - abs(c - n // 8 % 4)) * greatest(0, 1 - least(abs(o - n % 8), 8 - abs(o - n % 8)))) AS h FROM sh, ce GROUP BY ALL),
cl AS (SELECT *, least(h, 0.2 * sqrt(sum(h * h) OVER (PARTITION BY image_id, bi, bj))) AS k FROM hs), nd AS (SELECT *, sqrt(sum(k * k) OVER (PARTITION BY image_id, bi, bj)) AS norm FROM cl)
SELECT image_id, bi, bj, list(round(CASE WHEN norm > 0 THEN k / norm ELSE 0 END, 6) ORDER BY n) AS f FROM nd GROUP BY image_id, bi, bj""")
def dense_sift(spark, sf_dir):
    """The whole descriptor of every 4x4 block."""
    return I.dense_sift(images(spark, sf_dir), 4).select("image_id", "bi", "bj", F.transform("f", r6).alias("f"))


@query(f"""WITH {PX}, t AS (SELECT image_id, i, j, v > 0.05 AS edge, (j < 4)::INT AS t FROM px),
b AS (SELECT a.image_id, a.i, a.j FROM t a LEFT JOIN t c ON c.image_id = a.image_id AND c.i = a.i + 1 AND c.j = a.j + 1 LEFT JOIN t d ON d.image_id = a.image_id AND d.i = a.i + 1 AND d.j = a.j LEFT JOIN t e ON e.image_id = a.image_id AND e.i = a.i AND e.j = a.j + 1
  WHERE CASE WHEN a.i = 7 OR a.j = 7 THEN a.t ELSE abs(c.t - a.t) + abs(d.t - e.t) END > 0)
SELECT t.image_id, t.i, t.j, CASE WHEN any_value(edge) AND min(greatest(abs(t.i - b.i), abs(t.j - b.j))) <= 1 THEN 1 WHEN any_value(edge) AND min(greatest(abs(t.i - b.i), abs(t.j - b.j))) > 2 THEN -1 ELSE 0 END AS target
FROM t JOIN b USING (image_id) GROUP BY t.image_id, t.i, t.j""")
def splice_samples(spark, sf_dir):
    maps = images(spark, sf_dir).select("image_id", "h", "w", F.expr("transform(px, (x, p) -> if(p % 8 < 4, 1D, 0D))").alias("gt"), F.expr("transform(px, x -> if(x > 0.05, 1D, 0D))").alias("edge"))
    rows = W.features_of(I.splice_samples(maps, boundary=3, far=5))
    return rows.select("image_id", "i", "j", F.get("f", F.lit(0)).cast("int").alias("target"))


@query(f"WITH {PX} SELECT image_id, i, j, round(greatest(v, -v, v * 2, 0), 6) AS fused, round(greatest(v, -v, 0), 6) AS two_maps FROM px")
def fuse_maps(spark, sf_dir):
    v = F.col("v")
    return pixels(spark, sf_dir).select("image_id", "i", "j", r6(I.fuse_maps(v, -v, v * 2)).alias("fused"), r6(I.fuse_maps(v, -v, v * 2, legacy=True)).alias("two_maps"))


@query()
def kernel_spectra(spark, sf_dir):
    """Share of high frequencies in the kernels that synthetic shapes give."""
    from pixelloom.functions import grid
    from pixelloom.operators.subspace import fit_tree
    from pixelloom.sources.config import HopSpec

    tree = fit_tree(I.synthetic_shapes(spark), (HopSpec(window=5, border=None),))
    rows = [(k, float(e), grid.high_frequency_share(u.kernels[k].reshape(5, 5))) for u in tree.units[0] for k, e in enumerate(u.energy)]
    return spark.createDataFrame([(k, round(e, 6), round(s, 6)) for k, e, s in rows], "k long, energy double, share double")


@query(f"WITH {VX} SELECT id AS image_id, round(list_sum(list_transform(f, lambda x: abs(x) / list_sum(list_transform(f, lambda y: abs(y))))), 6) AS total FROM vx")
def normalized_edges(spark, sf_dir):
    from pixelloom.sources.images import normalized_edges as normalized

    edges = images(spark, sf_dir).withColumn("px", F.transform("px", lambda x: F.abs(x)))
    return normalized(edges).select("image_id", r6(V.total(F.col("px"))).alias("total"))
