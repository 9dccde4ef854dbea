"""Queries of aggregations, sampling and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import aggregates as A
from pixelloom.operators import metrics as M
from pixelloom.operators import sampling as S
from pixelloom.operators.joins import surround_in_images
from pixelloom.plans.fixtures import AROUND, PX, SIDE, VX, images, pixels, read, vectors
from pixelloom.plans.registry import query
from pixelloom.plans.vector_queries import _ENERGY_K, energies, r6

# ---- aggregations -------------------------------------------------------------------------------


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), c AS (SELECT id, pos, x, x - avg(x) OVER (PARTITION BY pos) AS a, x - avg(x) OVER (PARTITION BY id) AS b FROM l)
SELECT id, round(sum(a * (pos + 1)), 6) AS by_feature, round(sum(b * (pos + 1)), 6) AS by_row FROM c GROUP BY id""")
def remove_mean(spark, sf_dir):
    from pixelloom.functions.vector import subtract_mean

    rows = A.remove_feature_means(vectors(spark, sf_dir).withColumn("g", subtract_mean(F.col("f"))), 64)
    weighted = lambda c: r6(F.expr(f"aggregate(zip_with({c}, sequence(1, 64), (x, n) -> x * n), 0D, (s, x) -> s + x)"))
    return rows.select("id", weighted("f").alias("by_feature"), weighted("g").alias("by_row"))


@query(f"""WITH {VX}, l AS (SELECT id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx)
SELECT p.pos AS a, q.pos AS b, round(covar_samp(p.x, q.x), 9) AS cov FROM l p JOIN l q ON p.id = q.id AND p.pos <= q.pos GROUP BY p.pos, q.pos""")
def covariance(spark, sf_dir):
    rows = A.covariance(vectors(spark, sf_dir))
    return rows.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.round("cov", 9).alias("cov"))


@query(f"WITH {VX} SELECT round(max(sqrt(list_sum(list_transform(f, lambda x: x * x)))) / 8, 9) AS bias FROM vx")
def saab_bias(spark, sf_dir):
    return A.saab_bias(vectors(spark, sf_dir), 64).select(F.round("bias", 9).alias("bias"))


@query(f"WITH {VX} SELECT round(var_pop(list_sum(f) / 64 * 8), 9) AS variance FROM vx")
def dc_variance(spark, sf_dir):
    return A.dc_variance(vectors(spark, sf_dir), 64).select(F.round("variance", 9).alias("variance"))


_LABELLED = "x AS (SELECT d.lang AS cluster, l.toxic::BIGINT AS label, l.quality::BIGINT AS quality, d.doc_id, d.n_chars FROM documents d JOIN labels l USING (doc_id))"


def labelled(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("lang").alias("cluster"), F.col("toxic").cast("long").alias("label"), F.col("quality").cast("long").alias("quality"), "doc_id", "n_chars")


@query(f"""WITH {_LABELLED}, g AS (SELECT cluster, count(*) AS n, sum(label) AS p FROM x GROUP BY cluster)
SELECT cluster, n, round(p / n, 6) AS share_within, round(p / sum(p) OVER (), 6) AS share_of_all FROM g""")
def cluster_stats(spark, sf_dir):
    return A.cluster_shares(labelled(spark, sf_dir)).select("cluster", "n", r6("share_within").alias("share_within"), r6("share_of_all").alias("share_of_all"))


@query(f"""WITH {PX}, g AS (SELECT (image_id * 13 + pos * 5) % 7 AS cluster, count(*) AS n, avg(CASE WHEN d <> 0 AND label % 2 = 0 THEN 1 ELSE 0 END) AS rate FROM px GROUP BY 1)
SELECT (SELECT cluster FROM g ORDER BY rate DESC, cluster LIMIT 1) AS most_changed, (SELECT cluster FROM g ORDER BY rate, cluster LIMIT 1) AS least_changed,
  round(max(rate), 6) AS highest, round(min(rate), 6) AS lowest, sum(n)::BIGINT AS n FROM g""")
def extreme_clusters(spark, sf_dir):
    rows = pixels(spark, sf_dir).select(((F.col("image_id") * 13 + F.col("pos") * 5) % 7).alias("cluster"), F.when((F.col("d") != 0) & (F.col("label") % 2 == 0), 1).otherwise(0).alias("d"))
    return A.extreme_clusters(rows).select("most_changed", "least_changed", r6("highest").alias("highest"), r6("lowest").alias("lowest"), "n")


_BLOCKS = f"{PX}, e AS (SELECT image_id, label % 2 AS odd, i // 4 * 2 + j // 4 AS ch, var_pop(v) AS energy FROM px GROUP BY ALL)"


def _block_energies(spark, sf_dir):
    px = pixels(spark, sf_dir).withColumns({"odd": F.col("label") % 2, "ch": F.expr("i div 4 * 2 + j div 4")})
    return A.block_energy(px, "image_id", "odd", "ch")


@query(f"WITH {_BLOCKS} SELECT image_id, ch, round(energy, 9) AS energy FROM e")
def block_energy(spark, sf_dir):
    return _block_energies(spark, sf_dir).select("image_id", "ch", F.round("energy", 9).alias("energy"))


@query(f"WITH {_BLOCKS} SELECT ch, round(abs(avg(energy) FILTER (odd = 0) - avg(energy) FILTER (odd = 1)), 9) AS gap FROM e GROUP BY ch HAVING ch < 3")
def energy_gap(spark, sf_dir):
    rows = _block_energies(spark, sf_dir).withColumn("variant", F.when(F.col("odd") == 0, "cover").otherwise("stego"))
    return A.energy_gap(rows).select("ch", F.round("gap", 9).alias("gap"))


@query("SELECT round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS loss FROM lineitem")
def global_loss(spark, sf_dir):
    return A.weighted_loss(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount").select(F.round("loss", 8).alias("loss"))


@query("SELECT c_mktsegment AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM customer GROUP BY c_mktsegment")
def class_weights(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "label")
    return A.class_weights(rows).withColumn("weight", r6("weight"))


@query(f"WITH {PX} SELECT image_id, round(avg(CASE WHEN v > 0 THEN 1 ELSE 0 END), 6) AS mean, round(avg(CASE WHEN v > 0 THEN 0 ELSE 1 END), 6) AS share FROM px GROUP BY image_id")
def image_share(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("prediction", F.when(F.col("v") > 0, 1).otherwise(0))
    return A.image_share(rows).select("image_id", r6("mean").alias("mean"), r6("share").alias("share"))


@query("""WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type)
SELECT event_type, least(19, greatest(0, floor((value - lo) / (hi - lo) * 20)))::BIGINT AS bin, count(*) AS n FROM events JOIN g USING (event_type) WHERE value IS NOT NULL GROUP BY ALL""")
def hist_bins(spark, sf_dir):
    return A.histogram(read(spark, sf_dir, "events"), "value", 20, "event_type")


@query(f"""WITH {VX}, l AS (SELECT label, id, unnest(range(64)) AS pos, unnest(f) AS x FROM vx), v AS (SELECT label, pos, var_pop(x) AS v, count(*) AS n FROM l GROUP BY label, pos)
SELECT label AS node, any_value(n) AS n, round(avg(v), 9) AS mse, round(sum(v) * any_value(n), 6) AS sse FROM v GROUP BY label""")
def node_spread(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumnRenamed("label", "node")
    return A.node_spread(rows, "node", 64).select("node", "n", F.round("mse", 9).alias("mse"), r6("sse").alias("sse"))


@query(f"WITH {_LABELLED} SELECT cluster, count(*) AS n, round(greatest(sum(label), count(*) - sum(label)) / count(*), 6) AS purity FROM x GROUP BY cluster")
def purity(spark, sf_dir):
    return A.purity(labelled(spark, sf_dir), "cluster").withColumn("purity", r6("purity"))


@query(f"WITH {PX} SELECT image_id, i // 2 AS i, j // 2 AS j, round(max(v), 6) AS v FROM px GROUP BY ALL")
def block_pool_max(spark, sf_dir):
    return A.block_pool(pixels(spark, sf_dir), "max").withColumn("v", r6("v"))


@query(f"WITH {PX} SELECT image_id, i // 3 AS i, j // 3 AS j, round(sum(v) / 9, 6) AS v FROM px GROUP BY ALL")
def block_pool_avg(spark, sf_dir):
    """Blocks of three stick out over the edge and are filled up with zeros."""
    return A.block_pool(pixels(spark, sf_dir), "avg", 3).withColumn("v", r6("v"))


@query(f"WITH {AROUND} SELECT image_id, i, j, round(max(v), 6) AS largest, round(min(v), 6) AS smallest, round(avg(v), 6) AS mean FROM around GROUP BY image_id, i, j")
def surround_aggregate(spark, sf_dir):
    near = surround_in_images(images(spark, sf_dir), SIDE, SIDE).withColumn("a", A.aggregate_surround(F.col("around")))
    return near.select("image_id", "i", "j", *[r6(F.get("a", F.lit(k))).alias(n) for k, n in enumerate(("largest", "smallest", "mean"))])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 5")
def value_counts(spark, sf_dir):
    return A.value_counts(read(spark, sf_dir, "documents"), "source", 5)


@query("SELECT event_id, event_type, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM events WINDOW w AS (PARTITION BY event_type)")
def minmax_partition(spark, sf_dir):
    return A.min_max(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", "event_type").select("event_id", "event_type", r6("value").alias("value"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) * 2 + 1, 6) AS c_acctbal FROM customer")
def rescale(spark, sf_dir):
    return A.rescale(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").withColumn("c_acctbal", r6("c_acctbal"))


@query(f"WITH {PX} SELECT pos AS ch, round(var_pop(v), 9) AS variance FROM px GROUP BY pos")
def channel_variance(spark, sf_dir):
    return A.channel_variance(pixels(spark, sf_dir).withColumnRenamed("pos", "ch")).withColumn("variance", F.round("variance", 9))


@query(f"WITH {VX}, l AS (SELECT label, unnest(range(64)) AS pos, unnest(f) AS x FROM vx) SELECT label AS centroid, pos, round(avg(x), 6) AS mean FROM l GROUP BY label, pos")
def class_means(spark, sf_dir):
    rows = A.class_means(vectors(spark, sf_dir), 64).select("centroid", F.posexplode("c").alias("pos", "mean"))
    return rows.select("centroid", F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


@query(f"""WITH {PX}, g AS (SELECT pos % 8 AS leaf, count(*) AS n, var_pop(v) AS variance FROM px GROUP BY 1)
SELECT leaf, n, round(variance, 9) AS variance, (sum(CASE WHEN variance < 0.0155 THEN n ELSE 0 END) OVER ())::BIGINT AS low_rows FROM g""")
def leaf_variance(spark, sf_dir):
    rows = pixels(spark, sf_dir).select((F.col("pos") % 8).alias("leaf"), F.col("v").alias("y"))
    return A.leaf_variance(rows, low=0.0155).withColumn("variance", F.round("variance", 9))


@query(f"WITH {VX}, l AS (SELECT unnest(range(64)) AS pos, unnest(f) AS x FROM vx) SELECT pos, round(avg(x), 8) AS mean FROM l GROUP BY pos")
def feature_means(spark, sf_dir):
    rows = A.feature_means(vectors(spark, sf_dir))
    return rows.select(F.col("pos").cast("long").alias("pos"), F.round("mean", 8).alias("mean"))


# ---- sampling -----------------------------------------------------------------------------------

_H = "(({0} * 2654435761 + {1}) % 1000003)"


@query(f"SELECT doc_id FROM documents ORDER BY {_H.format('doc_id', 0)}, doc_id LIMIT 50")
def shuffled(spark, sf_dir):
    return S.shuffled(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", n=50)


@query(f"""WITH {PX}, r AS (SELECT image_id, sum(CASE WHEN d <> 0 THEN 1.0 ELSE 0 END)::DOUBLE / sum(CASE WHEN d = 0 THEN 1.0 ELSE 0 END)::DOUBLE AS rate FROM px GROUP BY image_id)
SELECT image_id, pos, d FROM px JOIN r USING (image_id) WHERE d <> 0 OR {_H.format('(image_id * 64 + pos)', 0)} / 1000003.0::DOUBLE < rate""")
def match_rate_sample(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("key", F.col("image_id") * 64 + F.col("pos"))
    return S.match_rate(rows, "key").select("image_id", "pos", "d")


@query(f"""SELECT doc_id, label FROM (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY {_H.format('doc_id', 0)}, doc_id) AS r FROM labels) WHERE r <= 20""")
def balanced_sample(spark, sf_dir):
    return S.balanced(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), 20, "doc_id")


@query(f"""WITH {PX}, k AS (SELECT image_id, pos, CASE WHEN v > 0.15 THEN 1 ELSE 0 END AS label, image_id * 64 + pos AS key FROM px),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, label > 0 ORDER BY {_H.format('key', 0)}, key) AS r, count(*) FILTER (label > 0) OVER (PARTITION BY image_id) AS p FROM k)
SELECT image_id, pos, CASE WHEN label > 0 OR r <= p THEN 1 ELSE 0 END AS take FROM r""")
def sample_indicator(spark, sf_dir):
    rows = pixels(spark, sf_dir).select("image_id", "pos", F.when(F.col("v") > 0.15, 1).otherwise(0).alias("label"), (F.col("image_id") * 64 + F.col("pos")).alias("key"))
    return S.indicators(rows, "key").select("image_id", "pos", "take")


@query(f"SELECT doc_id, CASE WHEN {_H.format('doc_id', 42 * 40503)} < 0.2 * 1000003 THEN 'test' ELSE 'train' END AS side FROM documents")
def split(spark, sf_dir):
    train, test = S.split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(f"SELECT doc_id, toxic AS label, (ntile(5) OVER (PARTITION BY toxic ORDER BY {_H.format('doc_id', 0)}, doc_id) - 1)::INT AS fold FROM labels")
def strat_fold(spark, sf_dir):
    return S.stratified_folds(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r > 100 AND r <= 250")
def fixed_split(spark, sf_dir):
    return S.between(read(spark, sf_dir, "orders").select("o_orderkey"), 100, 250, "o_orderkey")


@query(f"""WITH {PX}, o AS (SELECT unnest(range(-1, 2)) AS a), c AS (SELECT image_id, i, j FROM px WHERE v > 0.3),
w AS (SELECT image_id, i, j, i + x.a AS si, j + y.a AS sj FROM c, o x, o y), n AS (SELECT image_id, i, j, CASE WHEN si < 0 THEN 1 WHEN si > 7 THEN 6 ELSE si END AS si, CASE WHEN sj < 0 THEN 1 WHEN sj > 7 THEN 6 ELSE sj END AS sj FROM w)
SELECT n.image_id, n.i, n.j, round(sum(p.v), 6) AS total FROM n JOIN px p ON p.image_id = n.image_id AND p.i = n.si AND p.j = n.sj GROUP BY n.image_id, n.i, n.j""")
def gather_sampled(spark, sf_dir):
    """Neighbourhoods of indicated pixels only."""
    from pixelloom.functions.vector import total
    from pixelloom.operators.windows import features_of, neighbours

    wanted = pixels(spark, sf_dir).where("v > 0.3").select("image_id", "i", "j")
    rows = features_of(neighbours(images(spark, sf_dir))).join(wanted, ["image_id", "i", "j"], "left_semi")
    return rows.select("image_id", "i", "j", r6(total(F.col("f"))).alias("total"))


# ---- metrics ------------------------------------------------------------------------------------

_SCORED = f"{_LABELLED}, s AS (SELECT quality AS label, CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS prediction, least(0.99::DOUBLE, greatest(0.01::DOUBLE, n_chars / 4000.0::DOUBLE)) AS p FROM x)"


def scored(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("n_chars") / F.lit(4000.0)))
    return rows.select(F.col("quality").alias("label"), F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("prediction"), p.alias("p"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN label = prediction THEN 1 ELSE 0 END), 6) AS accuracy FROM s")
def accuracy(spark, sf_dir):
    return M.accuracy(scored(spark, sf_dir)).withColumn("accuracy", r6("accuracy"))


@query(f"WITH {_SCORED} SELECT label, prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM s GROUP BY label, prediction")
def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir)).withColumn("share", r6("share"))


@query(f"""WITH {_SCORED}, c AS (SELECT count(*) FILTER (label = 1 AND prediction = 1)::DOUBLE AS tp, count(*) FILTER (label = 0 AND prediction = 0)::DOUBLE AS tn,
count(*) FILTER (label = 0 AND prediction = 1)::DOUBLE AS fp, count(*) FILTER (label = 1 AND prediction = 0)::DOUBLE AS fn FROM s)
SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def mcc_f1(spark, sf_dir):
    return M.binary_scores(scored(spark, sf_dir)).select(r6("mcc").alias("mcc"), r6("f1").alias("f1"))


@query(f"""WITH {_SCORED}, g AS (SELECT p, sum(label)::DOUBLE AS a, sum(1 - label)::DOUBLE AS b FROM s GROUP BY p),
w AS (SELECT a, b, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM g)
SELECT round(sum(a * (u + b / 2)) / (sum(a) * sum(b)), 6) AS auc FROM w""")
def auc_rank(spark, sf_dir):
    return M.roc_auc(scored(spark, sf_dir), "p").withColumn("auc", r6("auc"))


@query(f"WITH {_SCORED} SELECT round(avg(-ln(CASE WHEN label = 1 THEN p ELSE 1 - p END)) / ln(2), 6) AS log_loss FROM s")
def logloss(spark, sf_dir):
    return M.log_loss(scored(spark, sf_dir), classes=2).withColumn("log_loss", r6("log_loss"))


@query(f"WITH {_SCORED} SELECT round(avg((label - p) * (label - p)), 6) AS plain, round(sum((label - p) * (label - p) * (1 + label)) / sum(1 + label), 6) AS weighted FROM s")
def squared_error(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("w", 1 + F.col("label"))
    a = M.squared_error(rows, "label", "p").select(r6("mse").alias("plain"))
    return a.crossJoin(M.squared_error(rows, "label", "p", "w").select(r6("mse").alias("weighted")))


@query(f"WITH {PX} SELECT round(avg(abs(0.01 * d)), 8) AS error FROM px")
def reconstruction_error(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("g", F.expr("transform(f, (x, p) -> x + if((id * 7 + p * 13) % 5 = 0, 0.01D, 0D))"))
    return M.reconstruction_error(rows).withColumn("error", F.round("error", 8))


@query(f"WITH {_ENERGY_K} SELECT layer, k, round(100 * sum(energy) OVER (PARTITION BY layer ORDER BY k) / sum(energy) OVER (PARTITION BY layer), 6) AS retained FROM en")
def energy_retained(spark, sf_dir):
    return M.energy_retained(energies(spark, sf_dir), "layer").select("layer", "k", r6("retained").alias("retained"))
