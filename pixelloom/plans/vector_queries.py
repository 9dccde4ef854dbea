"""Queries of scalar and vector functions and of projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import vector as V
from pixelloom.operators import projection as P
from pixelloom.plans.fixtures import PX, VX, pixels, read, vectors
from pixelloom.plans.registry import query


def r6(c):
    return F.round(c, 6)


def signed6(c):
    """As r6, but small negative values become -0.0 as in SQL. For values as they stand in a table: the sign of a sum's zero is chance."""
    return F.when(r6(c) == 0, c * 0.0).otherwise(r6(c))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), m AS (SELECT pos, avg(x) AS y FROM l GROUP BY pos)
SELECT id, round(sqrt(sum((x - y) * (x - y))), 6) AS euclidean, round(sum(abs(x - y)), 6) AS manhattan, round(max(abs(x - y)), 6) AS chebyshev,
  round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 6) AS cosine FROM l JOIN m USING (pos) GROUP BY id""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    mean = rows.agg(F.array(*[F.avg(F.get("f", F.lit(k))) for k in range(64)]).alias("m"))
    near = rows.crossJoin(F.broadcast(mean))
    f, m = F.col("f"), F.col("m")
    return near.select("id", r6(V.euclidean(f, m)).alias("euclidean"), r6(V.manhattan(f, m)).alias("manhattan"), r6(V.chebyshev(f, m)).alias("chebyshev"), r6(V.cosine(f, m)).alias("cosine"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(-2.0::DOUBLE, least(2.0::DOUBLE, l_tax * 100 - 4)), 6) AS clipped FROM lineitem")
def truncate_clip(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(V.clip(F.col("l_tax") * 100 - 4)).alias("clipped"))


@query("SELECT p_partkey, (" + " + ".join(f"((((p_size::BIGINT) >> {k}) & 1) << {7 - k})" for k in range(8)) + ")::BIGINT AS reversed FROM part")
def bit_reverse(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", V.reverse_bits(F.col("p_size")).alias("reversed"))


@query("SELECT p_partkey, (((p_size - p_partkey % 50) % 256 + 256) % 256)::BIGINT AS difference FROM part")
def uint8_wrap(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", V.wrapped_difference(F.col("p_size").cast("long"), F.col("p_partkey") % 50).alias("difference"))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(10)) AS pos, unnest(f[1:10]) AS x FROM vx), m AS (SELECT id, min(abs(x)) + 1e-15 AS lo FROM l GROUP BY id),
e AS (SELECT id, pos, exp(-abs(x) / lo * 0.05) AS e FROM l JOIN m USING (id))
SELECT id, pos, round(e / sum(e) OVER (PARTITION BY id), 6) AS share FROM e""")
def soft_targets(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", V.soft_target(F.transform(F.slice("f", 1, 10), lambda x: F.abs(x)), 0.05).alias("s"))
    return rows.select("id", F.posexplode("s").alias("pos", "share")).select("id", F.col("pos").cast("long").alias("pos"), r6("share").alias("share"))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(f) AS x FROM vx), m AS (SELECT id, x, x - min(x) OVER (PARTITION BY id) AS s FROM l)
SELECT id, round(max(s) / sum(s), 6) AS largest_share, round(sum(greatest(x, 0.0::DOUBLE)), 6) AS positive_sum FROM m GROUP BY id""")
def shift_normalize_relu(spark, sf_dir):
    f = F.col("f")
    return vectors(spark, sf_dir).select("id", r6(F.array_max(V.normalize_shifted(f))).alias("largest_share"), r6(V.total(V.relu(f))).alias("positive_sum"))


@query(f"""WITH {PX}, g AS (SELECT a.image_id, a.i, a.j, sqrt((b.v - a.v) * (b.v - a.v) + (c.v - a.v) * (c.v - a.v)) AS g FROM px a
JOIN px b ON a.image_id = b.image_id AND b.i = a.i + 1 AND b.j = a.j JOIN px c ON a.image_id = c.image_id AND c.i = a.i AND c.j = a.j + 1),
e AS (SELECT image_id, min(g) AS lo, max(g) AS hi FROM g GROUP BY image_id)
SELECT image_id, i, j, round((g - lo) / (hi - lo), 6) AS g FROM g JOIN e USING (image_id)""")
def gradient_magnitude(spark, sf_dir):
    from pixelloom.operators.aggregates import min_max

    px = pixels(spark, sf_dir).select("image_id", "i", "j", "v")
    down = px.select("image_id", (F.col("i") - 1).alias("i"), "j", F.col("v").alias("b"))
    right = px.select("image_id", "i", (F.col("j") - 1).alias("j"), F.col("v").alias("c"))
    g = px.join(down, ["image_id", "i", "j"]).join(right, ["image_id", "i", "j"])
    g = g.select("image_id", "i", "j", V.magnitude(F.col("b") - F.col("v"), F.col("c") - F.col("v")).alias("g"))
    return min_max(g, "g", "image_id").withColumn("g", r6("g"))


@query("SELECT l_orderkey, l_linenumber, round(0.2989 * l_quantity + 0.5870 * (l_discount * 100) + 0.1140 * (l_tax * 100), 6) AS gray FROM lineitem")
def rgb_to_gray(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", r6(V.gray(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)).alias("gray"))


@query("""SELECT p_partkey, len(x)::BIGINT AS n, list_sum(x)::BIGINT AS total FROM
(SELECT p_partkey, list_concat(range(p_size, p_size + 3), [(p_size + 5)::BIGINT]) AS x FROM part)""")
def range_list_parse(spark, sf_dir):
    text = F.expr("concat(p_size, '-', p_size + 2, ',', p_size + 5)")
    rows = read(spark, sf_dir, "part").select("p_partkey", V.parse_ranges(text).alias("x"))
    return rows.select("p_partkey", F.size("x").cast("long").alias("n"), F.expr("aggregate(x, 0L, (s, v) -> s + v)").alias("total"))


@query(f"WITH {PX} SELECT image_id || ' ' || i || ' ' || j AS key, image_id AS k, i, j FROM px")
def composite_key(spark, sf_dir):
    rows = pixels(spark, sf_dir).select(V.position_key(F.col("image_id"), F.col("i"), F.col("j")).alias("key"))
    return rows.withColumn("p", V.split_position_key(F.col("key"))).select("key", "p.k", "p.i", "p.j")


@query("""SELECT event_id, round(value, 2) AS rounded, least(7, greatest(0, floor(value / 25.0)))::BIGINT AS low_bin, ceil(value / 25.0)::BIGINT AS high_bin,
greatest(10.0::DOUBLE, least(90.0::DOUBLE, value)) AS clipped FROM events""")
def rounding_bins(spark, sf_dir):
    v = F.col("value")
    return read(spark, sf_dir, "events").select(
        "event_id", F.round(v, 2).alias("rounded"), V.bin_of(v, F.lit(0.0), F.lit(200.0), 8).alias("low_bin"), F.ceil(v / 25.0).cast("long").alias("high_bin"), V.clip(v, 10.0, 90.0).alias("clipped")
    )


@query("SELECT l_orderkey, l_linenumber, round(pow(l_quantity, -1) + pow(l_extendedprice / 1000, -1) + pow(1 + l_tax, -1), 6) AS cost FROM lineitem")
def reciprocal_power_mean(spark, sf_dir):
    values = [F.col("l_quantity"), F.col("l_extendedprice") / 1000, 1 + F.col("l_tax")]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(V.power_mean_sum(values)).alias("cost"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM events),
b AS (SELECT event_id, least(19, greatest(0, floor((value - lo) / (hi - lo) * 20)))::BIGINT AS b, n FROM events, e WHERE value IS NOT NULL),
s AS (SELECT b, count(*) / max(n) AS share FROM b GROUP BY b)
SELECT event_id, round(1 / greatest(share, 0.01), 6) AS weight FROM b JOIN s USING (b)""")
def inverse_frequency_weight(spark, sf_dir):
    from pixelloom.operators.learn import inverse_frequency_weights

    rows = read(spark, sf_dir, "events").where("value is not null").select("event_id", F.col("value").alias("y"))
    return inverse_frequency_weights(rows, "y", 20, 0.01).select("event_id", r6("weight").alias("weight"))


@query(f"WITH {VX} SELECT id, CASE WHEN list_sum(f[11:20]) > list_sum(f[1:10]) THEN 1 ELSE 0 END AS label FROM vx")
def prob_to_label(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", V.two_class_label(F.slice("f", 1, 20), 20).alias("label"))


@query(f"WITH {VX} SELECT id, CASE WHEN f[1] > 0 THEN 1 ELSE 0 END AS zero_one, CASE WHEN f[1] > 0 THEN 1 ELSE -1 END AS plus_minus FROM vx")
def sign_label(spark, sf_dir):
    x = F.get("f", F.lit(0))
    return vectors(spark, sf_dir).select("id", V.sign_label(x).alias("zero_one"), V.sign_label(x, -1).alias("plus_minus"))


@query(f"""WITH {VX} SELECT id, (list_position(f, list_max(f)) - 1)::BIGINT AS largest, (list_position(f, list_min(f)) - 1)::BIGINT AS smallest FROM vx""")
def arg_extremes(spark, sf_dir):
    f = F.col("f")
    return vectors(spark, sf_dir).select("id", V.arg_max(f).cast("long").alias("largest"), V.arg_min(f).cast("long").alias("smallest"))


@query(f"WITH {VX} SELECT id, round(list_sum(list_transform(f, lambda x: sqrt(abs(x)))), 6) AS total FROM vx")
def root_abs_sum(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", r6(V.root_abs_sum(F.col("f"))).alias("total"))


@query(f"WITH {PX} SELECT image_id, i, j, round(v, 6) AS v FROM px")
def pixels_explode(spark, sf_dir):
    return pixels(spark, sf_dir).select("image_id", "i", "j", r6("v").alias("v"))


@query(f"WITH {VX} SELECT id AS image_id, len(f)::BIGINT AS n, round(f[1], 6) AS first, round(f[64], 6) AS last FROM vx")
def pixels_collect(spark, sf_dir):
    rows = P.collect_pixels(pixels(spark, sf_dir))
    return rows.select("image_id", F.size("px").cast("long").alias("n"), r6(F.get("px", F.lit(0))).alias("first"), r6(F.get("px", F.lit(63))).alias("last"))


@query(f"""WITH {VX} SELECT id, round(f[8], 6) AS a, round(f[4], 6) AS b, round(f[41], 6) AS c, round(list_sum(f[11:20]), 6) AS slice_sum, round(list_sum(f[2:64]), 6) AS without_dc FROM vx""")
def channel_projection(spark, sf_dir):
    f = F.col("f")
    rows = vectors(spark, sf_dir).withColumn("g", P.gather_channels(f, [7, 3, 40]))
    return rows.select("id", *[r6(F.get("g", F.lit(k))).alias(n) for k, n in enumerate("abc")], r6(V.total(P.channel_slice(f, 10, 20))).alias("slice_sum"), r6(V.total(P.drop_dc(f))).alias("without_dc"))


@query(f"""WITH {PX}, c AS (SELECT image_id, i // 2 AS i, j // 2 AS j, max(v) AS m FROM px GROUP BY ALL)
SELECT p.image_id, p.i, p.j, 2::BIGINT AS n, round(p.v + c.m, 6) AS total FROM px p JOIN c ON p.image_id = c.image_id AND p.i // 2 = c.i AND p.j // 2 = c.j""")
def concat_hops(spark, sf_dir):
    from pixelloom.operators.aggregates import block_pool
    from pixelloom.operators.joins import with_coarse

    px = pixels(spark, sf_dir).select("image_id", "i", "j", "v")
    up = with_coarse(px, block_pool(px).withColumnRenamed("v", "m"), 2).select("image_id", "i", "j", F.array("m").alias("f"))
    both = P.concat_hops([px.select("image_id", "i", "j", F.array("v").alias("f")), up], lambda d: d.withColumn("f", P.concat_channels(F.col("f0"), F.col("f1"))))
    return both.select("image_id", "i", "j", F.size("f").cast("long").alias("n"), r6(V.total(F.col("f"))).alias("total"))


@query(f"WITH {VX} SELECT id, round(list_sum(list_transform(f, lambda x: x / 255)), 8) AS total, 1.0::DOUBLE AS label FROM vx")
def scale_and_label(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", F.round(V.total(P.scale(F.col("f"))), 8).alias("total"))
    return P.with_label(rows, 1)


_ENERGY = "e AS (SELECT s_nationkey::BIGINT % 3 AS layer, s_suppkey - 1 AS k, (s_suppkey * 37 % 101) / 101.0::DOUBLE AS energy FROM supplier)"
_ENERGY_K = f"{_ENERGY}, en AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY k) - 1 AS k, energy FROM e)"


def energies(spark, sf_dir):
    """(layer, k, energy) made of the suppliers."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "supplier").select((F.col("s_nationkey").cast("long") % 3).alias("layer"), F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") * 37 % 101) / 101.0).alias("energy"))
    return rows.withColumn("k", (F.row_number().over(Window.partitionBy("layer").orderBy("k")) - 1).cast("long"))


@query(f"""WITH {_ENERGY_K}, f AS (SELECT layer, k // 5 AS block, energy, count(*) OVER (PARTITION BY layer) AS n FROM en),
b AS (SELECT layer, block, count(*) FILTER (energy >= 0.5) AS kept FROM f WHERE block < n // 5 GROUP BY layer, block)
SELECT layer, block, kept, (sum(kept) OVER (ORDER BY layer, block))::BIGINT AS "offset" FROM b WHERE kept > 0""")
def construct_count(spark, sf_dir):
    return P.survived_offsets(energies(spark, sf_dir), 0.5, 5)


@query(f"WITH {PX} SELECT image_id, i, j, i // 3 AS ci, j // 3 AS cj FROM px")
def coarse_index(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return px.select("image_id", "i", "j", P.coarse_index(F.col("i"), 2).alias("ci"), P.coarse_index(F.col("j"), 2).alias("cj"))


@query(f"WITH {VX} SELECT id, round(list_sum(f[1:3]), 6) AS passed, round(list_sum(f[4:64]), 6) AS stayed FROM vx")
def pass_and_stay(spark, sf_dir):
    a, b = P.split_pass_stay(F.col("f"))
    return vectors(spark, sf_dir).select("id", r6(V.total(a)).alias("passed"), r6(V.total(b)).alias("stayed"))


@query(f"WITH {VX}, c AS (SELECT id, label, unnest(range(10)) AS class FROM vx) SELECT id, class, CASE WHEN class = label THEN 1.0 ELSE 0.0 END::DOUBLE AS hot FROM c")
def one_hot(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("id", F.posexplode(V.one_hot(F.col("label"), 10)).alias("class", "hot"))
    return rows.withColumn("class", F.col("class").cast("long"))


@query(f"WITH {VX} SELECT id, 65::BIGINT AS n, round(list_sum(f) + 1, 6) AS total FROM vx")
def append_bias(spark, sf_dir):
    f = P.append_bias(F.col("f"))
    return vectors(spark, sf_dir).select("id", F.size(f).cast("long").alias("n"), r6(V.total(f)).alias("total"))


@query(f"WITH {_ENERGY_K} SELECT layer, 0::BIGINT AS unit, k, round(energy, 6) AS first FROM en")
def kernels_by_layer(spark, sf_dir):
    params = energies(spark, sf_dir).select("layer", F.lit(0).cast("long").alias("unit"), "k", F.array(r6("energy")).alias("kernel"))
    return P.kernels_by_layer(params).select("layer", "unit", "k", F.get("kernel", F.lit(0)).alias("first"))

