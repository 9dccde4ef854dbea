"""Queries of k-means trees, their starts and losses, and the models in their leaves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixelloom.functions.forest import Constant, Forest
from pixelloom.operators import cluster as L
from pixelloom.operators import trees as T
from pixelloom.operators.lag_unit import LagUnit
from pixelloom.operators.learn import inverse_frequency_weights
from pixelloom.operators.windows import zigzag
from pixelloom.plans import tree_sql as S
from pixelloom.plans.fixtures import images, vectors
from pixelloom.plans.learner_queries import binary, solved
from pixelloom.plans.registry import query
from pixelloom.plans.vector_queries import r6


def digits(spark, sf_dir):
    """(id, f, label, y): y is the digit as a number."""
    return vectors(spark, sf_dir).withColumn("y", F.col("label").cast("double"))


# ---- starts, losses -----------------------------------------------------------------------------


def _lbg_sql() -> str:
    ctes = [S.ROWS, "r AS MATERIALIZED (SELECT id, 'R' AS node FROM x)", S.figures("g", "r")]
    last = {}
    for how in ("plus", "minus", "both"):
        more, last[how] = S.lbg(how, 5)
        ctes += more
    return ",\n".join(ctes) + " " + " UNION ALL ".join(f"SELECT '{how}' AS start, round(sum(far), 4) AS cost FROM {a}" for how, a in last.items())


@query(_lbg_sql())
def lbg_split(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    mean, deviation = L.mean_and_deviation(rows, 64)
    out = [(how, round(L.lloyd(rows, L.lbg_starts(mean, deviation, how), max_iter=5)[1], 4)) for how in ("plus", "minus", "both")]
    return spark.createDataFrame(out, "start string, cost double")


def _trials_sql() -> str:
    ctes = [S.ROWS, "r AS MATERIALIZED (SELECT id, 'R' AS node FROM x)", S.figures("g", "r")]
    last = []
    for how in ("plus", "minus", "both"):
        more, a = S.lbg(how, 10)
        ctes += more
        last.append(a)
    ctes.append(f"o AS MATERIALIZED (SELECT id, f, row_number() OVER (ORDER BY {S.distance('f', 'mean')} DESC, id) AS rank, list_transform(list_zip(f, mean), lambda z: z[1] - z[2]) AS d FROM x, g QUALIFY rank <= 20)")
    ctes.append("best AS MATERIALIZED (SELECT a.f AS p, b.f AS q FROM o a JOIN o b ON a.rank < b.rank ORDER BY abs(list_cosine_similarity(a.d, b.d)), a.rank, b.rank LIMIT 1)")
    ctes.append("b_far(node, child, c) AS (SELECT 'R', k, CASE WHEN k = 0 THEN p ELSE q END FROM best, (SELECT unnest([0, 1]) AS k))")
    more, _ = S.settled("far", "r", "b_far", 10)
    costs = " UNION ALL ".join(f"SELECT sum(far) AS cost FROM {a}" for a in [*last, "far_a9"])
    return ",\n".join([*ctes, *more]) + f" SELECT 2::BIGINT AS centres, round(min(cost), 2) AS cost FROM ({costs})"


@query(_trials_sql())
def multi_trial(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    centres, cost = L.best_of_trials(rows, 64)
    return spark.createDataFrame([(len(centres), round(cost, 2))], "centres long, cost double")


@query(",\n".join([S.ROWS, "r AS MATERIALIZED (SELECT id, 'R' AS node FROM x)", S.figures("g", "r"), *S.lbg("plus", 1)[0]]) + f""",
k AS (SELECT child, count(*) AS n, sum(far) AS sse, avg(y) AS p FROM plus_a0 JOIN x USING (id) GROUP BY child), t AS (SELECT sum(n) AS t FROM k)
SELECT round((SELECT abs(n - t / 2) / t FROM k, t WHERE child = 0) + (SELECT sum(sse) FROM k) / (SELECT spread * n FROM g) + (SELECT sum(n / t * ({S.ENTROPY})) FROM k, t), 6) AS loss""")
def composite_loss(spark, sf_dir):
    rows = binary(spark, sf_dir)
    mean, deviation = L.mean_and_deviation(rows, 64)
    loss = L.split_loss(rows, L.lbg_starts(mean, deviation), 64, float((deviation**2).sum()) * rows.count())
    return spark.createDataFrame([(round(float(loss), 6),)], "loss double")


_TEN = ",\n".join([S.ROWS, "r AS MATERIALIZED (SELECT id, 'R' AS node FROM x)", "b AS MATERIALIZED (SELECT 'R' AS node, row_number() OVER (ORDER BY sha256(id::VARCHAR)) - 1 AS child, f AS c FROM x QUALIFY child < 10)"])


def _settled(spark, sf_dir, steps: int = 10):
    """Rows with the nearest of ten centres that settled from the vectors of lowest SHA-256 of their ids."""
    rows = binary(spark, sf_dir).withColumn("node", F.lit("R"))
    starts = T.lowest(rows, ["R"], 10, order=F.sha2(F.col("id").cast("string"), 256))
    return L.assign(rows.drop("node"), T.settle(rows, starts, 64, steps)["R"].tolist())


@query(",\n".join([_TEN, *S.settled("k", "r", "b", 10)[0], S.assigned("z", "r", "k_c9")]) + " SELECT child AS cluster, count(*) AS n, round(sum(far), 4) AS cost FROM z GROUP BY child")
def settled_kmeans(spark, sf_dir):
    """k-means from stated starts: sizes and costs of the clusters."""
    return _settled(spark, sf_dir).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.sum(F.col("distance") ** 2), 4).alias("cost"))


@query(",\n".join([_TEN, *S.settled("k", "r", "b", 10)[0], S.assigned("z", "r", "k_c9")]) + """, n AS (SELECT child, y, count(*) AS n FROM z JOIN x USING (id) GROUP BY child, y), p AS (SELECT n, n / sum(n) OVER (PARTITION BY child) AS p FROM n)
SELECT round(sum(-ln(p) * n) / sum(n) / ln(2), 6) AS ce FROM p""")
def settled_entropy(spark, sf_dir):
    """Entropy of the class within those clusters."""
    from pixelloom.operators.select import cluster_entropy

    return cluster_entropy(None, 10, 2, placed=_settled(spark, sf_dir)).withColumn("ce", r6("ce"))


def _lag_sql() -> str:
    """Clusters inside classes, shares of a row among those of its class, the linear map onto them, and the entropies of its outputs."""
    rows = [S.ROWS.replace("WITH ", "WITH RECURSIVE ", 1), "r AS MATERIALIZED (SELECT id, label::VARCHAR AS node FROM x)"]
    rows.append("b AS MATERIALIZED (SELECT label::VARCHAR AS node, row_number() OVER (PARTITION BY label ORDER BY sha256(id::VARCHAR)) - 1 AS child, f AS c FROM x QUALIFY child < 2)")
    rows += [*S.settled("k", "r", "b", 10)[0], S.assigned("z", "r", "k_c9")]
    far = S.distance("x.f", "c.c")
    rows.append(f"""d AS (SELECT id, label * 2 + child AS j, sqrt({far}) AS d FROM x JOIN k_c9 c ON c.node = x.label::VARCHAR), g AS (SELECT id, j, exp(-10 * d / (min(d) OVER (PARTITION BY id) + 1e-5)) AS g FROM d),
t AS MATERIALIZED (SELECT id, 65 + j AS p, g / sum(g) OVER (PARTITION BY id) AS v FROM g),
q AS MATERIALIZED (SELECT id, pos AS p, (v - avg(v) OVER (PARTITION BY pos)) / stddev_pop(v) OVER (PARTITION BY pos) AS v FROM l UNION ALL SELECT id, 64, 1.0 FROM x),
a AS MATERIALIZED (SELECT * FROM q UNION ALL SELECT * FROM t UNION ALL SELECT id, 65 + j, 0.0 FROM x, (SELECT unnest(range(20)) AS j) WHERE j // 2 <> label),
n AS (SELECT u.p AS i, v.p AS j, sum(u.v * v.v) AS v FROM a u JOIN a v USING (id) WHERE u.p < 65 GROUP BY u.p, v.p), e AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM n GROUP BY i))""")
    rows.append(solved(65))
    rows.append("""u AS MATERIALIZED (SELECT id, list(v ORDER BY p) AS z FROM q GROUP BY id), o AS MATERIALIZED (SELECT id, j, list_sum(list_transform(range(1, 66), lambda i: z[i] * w[i][66 + j])) AS o FROM u, s, (SELECT unnest(range(20)) AS j)),
h AS (SELECT o.id, j, greatest(0, ceil((o - min(o) OVER (PARTITION BY j)) / (max(o) OVER (PARTITION BY j) - min(o) OVER (PARTITION BY j)) * 10) - 1) AS bin, label FROM o JOIN x USING (id)),
size AS (SELECT label, count(*) AS size FROM x GROUP BY label), f2 AS (SELECT j, bin, label, count(*) / any_value(size) AS f FROM h JOIN size USING (label) GROUP BY j, bin, label),
lead AS (SELECT j, bin, min_by(label, {'f': -f, 'c': label}) AS label FROM f2 GROUP BY j, bin), led AS (SELECT j, label, count(*) AS led FROM lead GROUP BY j, label), used AS (SELECT j, count(*) AS used FROM lead GROUP BY j),
p AS (SELECT used.j, size.label, size, (coalesce(led, 0) + CASE WHEN size.label = 0 THEN 10 - used ELSE 0 END) / 10.0::DOUBLE AS p FROM used CROSS JOIN size LEFT JOIN led ON led.j = used.j AND led.label = size.label)""")
    return ",\n".join(rows) + """ SELECT p.j AS output, p.j // 2 AS class, any_value(c.n) AS n, round(sum(size * -ln(p + 1e-9)), 3) AS entropy FROM p
JOIN (SELECT node::BIGINT * 2 + child AS j, count(*) AS n FROM z GROUP BY 1) c ON c.j = p.j GROUP BY p.j"""


@query(_lag_sql())
def lag_first_round(spark, sf_dir):
    """The first round of the splitting unit: clusters, and the entropy of every output."""
    unit = LagUnit.fit(vectors(spark, sf_dir), 64, 10, 2, rounds=0, order=F.sha2(F.col("id").cast("string"), 256))
    r = unit.rounds[0]
    return spark.createDataFrame([(j, int(c), int(r.sizes[j]), float(np.round(r.entropy[j], 3))) for j, c in enumerate(r.owner)], "output long, class long, n long, entropy double")


# ---- trees --------------------------------------------------------------------------------------


def _table(spark, tree, figure: str = "purity"):
    return spark.createDataFrame([(n["node"], n["n"], round(n[figure], 6), n["leaf"]) for n in tree.rows()], f"node string, n long, {figure} double, leaf boolean")


_PURITY = " SELECT node, n, round(greatest(p, 1 - p), 6) AS purity, leaf FROM tree"


@query(S.binary_tree("spread", 4, 20) + _PURITY)
def hier_tree(spark, sf_dir):
    return _table(spark, T.grow(binary(spark, sf_dir), 64, 4, "spread", 20)[1])


@query(S.binary_tree("purity", 4, 20) + _PURITY)
def purity_tree(spark, sf_dir):
    return _table(spark, T.grow(binary(spark, sf_dir), 64, 4, "purity", 20)[1])


@query(S.binary_tree("variance", 4, 20) + _PURITY)
def variance_tree(spark, sf_dir):
    return _table(spark, T.grow(binary(spark, sf_dir), 64, 4, "variance", 20)[1])


@query(S.binary_tree("loss", 4, 20, guided=True) + " SELECT node, n, round(h, 6) AS entropy, leaf FROM tree")
def loss_guided_tree(spark, sf_dir):
    return _table(spark, T.grow(binary(spark, sf_dir), 64, 4, "loss", 20, accept=T.accept_by_loss())[1], "entropy")


@query(S.full_tree(3, 2) + " SELECT node, count(*) AS n, round(avg(y), 6) AS share FROM a2 JOIN x USING (id) GROUP BY node")
def full_tree(spark, sf_dir):
    """Every node split into three, down to the second level."""
    rows, _ = T.grow_full(binary(spark, sf_dir), 64, 3, 2, order=F.sha2(F.col("id").cast("string"), 256))
    return rows.groupBy("node").agg(F.count("*").alias("n"), r6(F.avg("label")).alias("share"))


@query(S.binary_tree("spread", 5, 100).replace("WHERE n >= 200 AND spread > 0)", "WHERE n >= 200 AND spread > 0.12)") + """
, taken AS (SELECT f.node FROM f JOIN f c ON c.parent = f.node WHERE f.n >= 200 AND f.spread > 0.12 GROUP BY f.node HAVING count(*) = 2)
SELECT node, n, node NOT IN (SELECT node FROM taken) AS leaf FROM f WHERE node = 'R' OR parent IN (SELECT node FROM taken)""")
def threshold_tree(spark, sf_dir):
    """Every leaf with at least 200 rows and a mean squared distance over 0.12 is split."""
    _, tree = T.grow_until(binary(spark, sf_dir), 64, 0.12, 100)
    return spark.createDataFrame([(n["node"], n["n"], n["leaf"]) for n in tree.rows()], "node string, n long, leaf boolean")


@query(S.binary_tree("spread", 3, 20) + ",\n" + S.routed() + """,
a AS (SELECT own.node, sum((own.node <> near.node)::INT)::BIGINT AS moved, greatest(avg(y), 1 - avg(y)) AS before FROM own JOIN near USING (id) JOIN x USING (id) GROUP BY own.node),
b AS (SELECT node, greatest(avg(y), 1 - avg(y)) AS after FROM near JOIN x USING (id) GROUP BY node)
SELECT node, moved, round(before, 6) AS purity_before, round(after, 6) AS purity_after FROM a FULL JOIN b USING (node)""")
def tree_routing(spark, sf_dir):
    """Rows to the nearest leaf of a tree, and which leaves changed their rows."""
    rows = binary(spark, sf_dir).withColumnRenamed("id", "sample_id")
    placed, tree = T.grow(rows, 64, 3, "spread", 20)
    return L.leaf_report(placed.select("sample_id", "node", "label"), tree.nearest(rows).select("sample_id", "node")).select("node", "moved", r6("purity_before").alias("purity_before"), r6("purity_after").alias("purity_after"))


# ---- models in leaves ---------------------------------------------------------------------------


def _sizes(tree) -> dict[str, int]:
    return {s["node"]: s["n"] for s in tree.leaves}


@query(S.binary_tree("spread", 3, 20) + ",\n" + S.routed() + """,
e AS (SELECT min(label) AS lo, max(label) AS hi, count(*) AS n FROM x), w AS (SELECT id, least(19, floor((label - lo) / (hi - lo) * 20)) AS bin FROM x, e),
q AS (SELECT id, 1 / greatest(count(*) OVER (PARTITION BY bin) / n, 0.001) AS w FROM w, e),
m AS (SELECT node, sum(w * label) / sum(w) AS prediction FROM own JOIN q USING (id) JOIN x USING (id) GROUP BY node)
SELECT id, near.node, round(prediction, 6) AS prediction FROM near JOIN m USING (node)""")
def leaf_means(spark, sf_dir):
    """The weighted mean of each leaf, predicted for the rows nearest to it."""
    rows = digits(spark, sf_dir)
    _, tree = T.grow(rows.withColumn("label", (F.col("label") >= 5).cast("long")), 64, 3, "spread", 20)
    weighted = inverse_frequency_weights(tree.descend(rows), "y")
    models = T.LeafModels.fit(weighted, _sizes(tree), Constant(), 64, weight="weight", sample=1 << 40)
    return models.predict(tree.nearest(rows)).select("id", "node", r6(F.get("prediction", F.lit(0))).alias("prediction"))


@query()
def leaf_forest(spark, sf_dir):
    """A variance-guided tree on standardized components with a forest in each leaf; rows go where the splits lead them."""
    rows = digits(spark, sf_dir)
    placed, tree = T.grow(rows, 64, 4, "variance", 20, label="y", scale=True)
    models = T.LeafModels.fit(placed, _sizes(tree), Forest(20, 6, 5), 64)
    return models.predict(tree.descend(rows)).select("id", "node", r6(F.get("prediction", F.lit(0))).alias("prediction"))


@query()
def leaf_regression(spark, sf_dir):
    """A tree that splits the leaf of largest error, weighted forests in its leaves, and the model of the nearest leaf."""
    rows = digits(spark, sf_dir)
    placed, tree = T.grow(rows, 64, 4, "error", 20, label="y")
    models = T.LeafModels.fit(inverse_frequency_weights(placed, "y"), _sizes(tree), Forest(10, 5, 5), 64, weight="weight")
    return models.predict(tree.nearest(rows)).select("id", "node", r6(F.get("prediction", F.lit(0))).alias("prediction"))


@query()
def leaf_classifier(spark, sf_dir):
    """A full tree of depth 2 with a classifier in each leaf: the probabilities of all ten digits."""
    rows = vectors(spark, sf_dir)
    placed, tree = T.grow_full(rows, 64, 3, 2, order=F.sha2(F.col("id").cast("string"), 256))
    models = T.LeafModels.fit(placed, _sizes(tree), Forest(20, 5, 2), 64, classes=10, y="label")
    out = models.predict(tree.descend(rows))
    return out.select("id", "label", "node", F.transform("prediction", r6).alias("probability"))


@query()
def held_out_tree(spark, sf_dir):
    """Splits are taken only if small forests in the children lose less on held-out rows than one in the parent."""
    rows = binary(spark, sf_dir)
    price = T.held_out_loss(Forest(10, 5, 2, balanced=True), 2)
    _, tree = T.grow(rows, 64, 4, "error", 20, price=price, accept=T.accept_by_loss(0.0, "loss"))
    return spark.createDataFrame([(n["node"], n["n"], round(n["loss"], 6), n["leaf"]) for n in tree.rows()], "node string, n long, loss double, leaf boolean")


@query()
def growing_subset_tree(spark, sf_dir):
    """Pixels by their 3x3 surroundings; nodes are fitted on the first zig-zag groups of pixels that give them enough rows."""
    from pixelloom.functions import grid
    from pixelloom.operators.subspace import per_image
    from pixelloom.operators.windows import features_of

    pixels = features_of(per_image(images(spark, sf_dir), lambda x: grid.gather(x, 3, "reflect")))
    group = F.element_at(F.array(*[F.lit(r) for _, _, r in sorted(zigzag(4))]), ((F.col("i") % 4) * 4 + F.col("j") % 4 + 1).cast("int"))
    rows = pixels.withColumn("group", group).withColumn("label", F.lit(None).cast("double"))
    n = rows.count()
    _, tree = T.grow_until(rows, 9, 0.35, n // 20, measure="distance", group="group", enough=n // 20)
    return spark.createDataFrame([(s["node"], s["n"], s["used"], s["used_groups"], s["leaf"]) for s in tree.rows()], "node string, n long, used long, used_groups long, leaf boolean")
