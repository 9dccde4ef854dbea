"""Aggregations over pixels, channels, clusters and nodes; all with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.vector import bin_of, norm


def feature_means(rows: DataFrame, f: str = "f", *by: str) -> DataFrame:
    """Mean of each position over the rows: (by.., pos, mean)."""
    return rows.select(*by, F.posexplode(f).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))


def remove_feature_means(rows: DataFrame, size: int, f: str = "f") -> DataFrame:
    """Subtract each position's mean over all rows. The means are one row of `size` numbers."""
    means = rows.agg(F.array(*[F.avg(F.get(f, F.lit(k))) for k in range(size)]).alias("_m"))
    return rows.crossJoin(F.broadcast(means)).withColumn(f, F.zip_with(f, "_m", lambda x, m: x - m)).drop("_m")


def covariance(rows: DataFrame, f: str = "f", *by: str) -> DataFrame:
    """Sample covariance of positions: (by.., a, b, cov) for a <= b."""
    a = rows.select(*by, "f" if f == "f" else F.col(f).alias("f"), F.posexplode(f).alias("a", "x"))
    pairs = a.select(*by, "a", "x", F.posexplode("f").alias("b", "y")).where("a <= b")
    return pairs.groupBy(*by, "a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def saab_bias(rows: DataFrame, size: int, f: str = "f") -> DataFrame:
    """Largest row norm over the root of the number of features."""
    return rows.agg((F.max(norm(F.col(f))) / F.sqrt(F.lit(float(size)))).alias("bias"))


def dc_variance(rows: DataFrame, size: int, f: str = "f") -> DataFrame:
    """Population variance of the rows' means, scaled by the root of the number of features."""
    from pixelloom.functions.vector import mean

    return rows.agg(F.var_pop(mean(F.col(f)) * F.sqrt(F.lit(float(size)))).alias("variance"))


def cluster_shares(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Per cluster its rows, the share of positives in it, and its share of all positives."""
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    return per.select(cluster, "n", (F.col("positives") / F.col("n")).alias("share_within"), (F.col("positives") / F.sum("positives").over(Window.partitionBy())).alias("share_of_all"))


def extreme_clusters(rows: DataFrame, cluster: str = "cluster", diff: str = "d") -> DataFrame:
    """The clusters with the highest and the lowest change rate, and their share of the rows (ties: smaller id)."""
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.avg((F.col(diff) != 0).cast("double")).alias("rate"))
    top = F.max_by(F.col(cluster), F.struct("rate", -F.col(cluster)))
    low = F.min_by(F.col(cluster), F.struct("rate", F.col(cluster)))
    return per.agg(top.alias("most_changed"), low.alias("least_changed"), F.max("rate").alias("highest"), F.min("rate").alias("lowest"), F.sum("n").alias("n"))


def block_energy(pixels: DataFrame, *by: str, value: str = "v") -> DataFrame:
    """Mean squared deviation from the channel mean, per block and channel."""
    return pixels.groupBy(*by).agg(F.var_pop(value).alias("energy"))


def energy_gap(energies: DataFrame) -> DataFrame:
    """Per channel the absolute difference of mean energies of cover and stego; the last channel is left out."""
    per = energies.groupBy("ch").agg(F.avg(F.when(F.col("variant") == "cover", F.col("energy"))).alias("c"), F.avg(F.when(F.col("variant") == "stego", F.col("energy"))).alias("s"))
    last = F.max("ch").over(Window.partitionBy())
    return per.withColumn("_last", last).where("ch < _last").select("ch", F.abs(F.col("c") - F.col("s")).alias("gap"))


def weighted_loss(nodes: DataFrame, n: str = "n", h: str = "h") -> DataFrame:
    return nodes.agg((F.sum(F.col(n) * F.col(h)) / F.sum(n)).alias("loss"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    per = rows.groupBy(label).agg(F.count("*").alias("n"))
    return per.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy()))


def image_share(rows: DataFrame, prediction: str = "prediction", value: int = 0, key: str = "image_id") -> DataFrame:
    """Per image the mean prediction and the share that equals `value`."""
    return rows.groupBy(key).agg(F.avg(prediction).alias("mean"), F.avg((F.col(prediction) == value).cast("double")).alias("share"))


def histogram(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """Counts of equal-width bins between the extremes (of each group): (by.., bin, n)."""
    if by:
        ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        rows = rows.join(ends, list(by))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))
    return rows.where(F.col(value).isNotNull()).groupBy(*by, bin_of(F.col(value), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"))


def node_spread(rows: DataFrame, node: str, size: int, f: str = "f", target: str | None = None) -> DataFrame:
    """Per node its rows, the mean of its features' variances (mse), their sum of squared errors, and the target's."""
    variances = [F.var_pop(F.get(f, F.lit(k))) for k in range(size)]
    mse = sum(variances[1:], variances[0]) / size
    extra = [(F.var_pop(target) * F.count("*")).alias("target_sse")] if target else []
    return rows.groupBy(node).agg(F.count("*").alias("n"), mse.alias("mse"), (mse * size * F.count("*")).alias("sse"), *extra)


def purity(rows: DataFrame, node: str, label: str = "label") -> DataFrame:
    """Share of the larger of two classes (labels 0 and 1)."""
    one = F.sum(label)
    return rows.groupBy(node).agg(F.count("*").alias("n"), (F.greatest(one, F.count("*") - one) / F.count("*")).alias("purity"))


def block_pool(pixels: DataFrame, how: str = "max", k: int = 2, height: int | None = None, width: int | None = None, value: str = "v") -> DataFrame:
    """k x k pooling; blocks that stick out over an edge are filled up with zeros."""
    keys = [F.expr(f"i div {k}").alias("i"), F.expr(f"j div {k}").alias("j")]
    per = pixels.groupBy("image_id", *keys)
    if how == "avg":
        return per.agg((F.sum(value) / (k * k)).alias(value))
    return per.agg(F.when(F.count("*") < k * k, F.greatest(F.max(value), F.lit(0.0))).otherwise(F.max(value)).alias(value))


def aggregate_surround(around: Column, modes: Iterable[int] = (1, 2, 3)) -> Column:
    """Maximum (1), minimum (2) and mean (3) of a neighbourhood array."""
    from pixelloom.functions.vector import mean

    made = {1: F.array_max(around), 2: F.array_min(around), 3: mean(around)}
    return F.array(*[made[m] for m in modes])


def value_counts(rows: DataFrame, value: str, least: int = 0) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def min_max(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Scale to 0..1 within each group, or over all rows; a constant group gives NaN as 0 / 0 does."""
    if by:
        ends = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        rows = rows.join(ends, list(by))
    else:
        rows = rows.crossJoin(F.broadcast(rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))))
    spread = F.col("_hi") - F.col("_lo")
    return rows.withColumn(value, F.when(spread == 0, F.lit(float("nan"))).otherwise((F.col(value) - F.col("_lo")) / spread)).drop("_lo", "_hi")


def rescale(rows: DataFrame, value: str, low: float = 1.0, high: float = 3.0) -> DataFrame:
    return min_max(rows, value).withColumn(value, F.col(value) * (high - low) + low)


def channel_variance(pixels: DataFrame, ch: str = "ch", value: str = "v") -> DataFrame:
    return pixels.groupBy(ch).agg(F.var_pop(value).alias("variance"))


def class_means(rows: DataFrame, size: int, f: str = "f", label: str = "label") -> DataFrame:
    """Mean vector per class: initial centroids (centroid, c)."""
    means = F.array(*[F.avg(F.get(f, F.lit(k))) for k in range(size)])
    return rows.groupBy(F.col(label).alias("centroid")).agg(means.alias("c"))


def leaf_variance(rows: DataFrame, leaf: str = "leaf", target: str = "y", low: float = 0.1) -> DataFrame:
    """Per leaf the target's variance and rows, and the rows that all leaves below `low` hold."""
    per = rows.groupBy(leaf).agg(F.count("*").alias("n"), F.var_pop(target).alias("variance"))
    return per.withColumn("low_rows", F.sum(F.when(F.col("variance") < low, F.col("n")).otherwise(0)).over(Window.partitionBy()))
