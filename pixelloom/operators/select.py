"""Feature selection by entropy, information and energy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.vector import bin_of
from pixelloom.sources.scratch import bounded


def _binned(rows: DataFrame, bins: int, f: str, label: str) -> DataFrame:
    long = rows.select(F.col(label).alias("y"), F.posexplode(f).alias("feature", "x"))
    ends = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return long.join(bounded(ends), "feature").where("hi > lo").groupBy("feature", bin_of(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"), "y").agg(F.count("*").alias("n"))


def bin_entropy(rows: DataFrame, classes: int, bins: int = 10, f: str = "f", label: str = "label") -> DataFrame:
    """Per feature the mean over samples of -log(share of bins that the sample's class leads) / log(classes). A bin is led by the
    class with the largest share of its own samples there, the smallest class on ties; empty bins go to class 0.
    Constant features are left out."""
    counts = _binned(rows, bins, f, label)
    sizes = rows.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("size"))
    shares = counts.join(bounded(sizes), "y").withColumn("share", F.col("n") / F.col("size"))
    leads = shares.groupBy("feature", "bin").agg(F.max_by("y", F.struct("share", -F.col("y"))).alias("y"))
    led = leads.groupBy("feature", "y").agg(F.count("*").alias("led"))
    used = leads.groupBy("feature").agg(F.count("*").alias("used"))
    grid = used.crossJoin(bounded(sizes)).join(led, ["feature", "y"], "left")
    p = (F.coalesce("led", F.lit(0)) + F.when(F.col("y") == 0, bins - F.col("used")).otherwise(0)) / bins
    total = F.sum("size").over(Window.partitionBy("feature"))
    return grid.withColumn("h", F.col("size") / total * -F.log10(p + 1e-5) / math.log10(classes)).groupBy("feature").agg(F.sum("h").alias("ce"))


def correct_class_entropy(rows: DataFrame, bins: int = 10, f: str = "f", label: str = "label", tiny: float = 1e-12) -> DataFrame:
    """Per feature the sum over samples of -ln(share of the sample's class in its bin)."""
    counts = _binned(rows, bins, f, label)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("feature", "bin"))
    return counts.withColumn("h", -F.log(F.greatest(p, F.lit(tiny))) * F.col("n")).groupBy("feature").agg(F.sum("h").alias("ce"))


def mutual_information(rows: DataFrame, bins: int = 10, f: str = "f", label: str = "label") -> DataFrame:
    """Information between binned features and the label, in nats; information.py has the estimate by nearest neighbours."""
    counts = _binned(rows, bins, f, label)
    w = Window.partitionBy("feature")
    counts = counts.withColumns({"t": F.sum("n").over(w), "b": F.sum("n").over(Window.partitionBy("feature", "bin")), "c": F.sum("n").over(Window.partitionBy("feature", "y"))})
    mi = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("b") * F.col("c")))
    return counts.groupBy("feature").agg(F.sum(mi).alias("mi"))


def histogram_entropy(rows: DataFrame, value: str, bins: int, *by: str) -> DataFrame:
    """Entropy of an equal-width histogram over the logarithm of the number of bins."""
    from pixelloom.operators.aggregates import histogram

    counts = histogram(rows, value, bins, *by)
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("h", -p * F.log(p)).groupBy(*by).agg((F.sum("h") / math.log(bins)).alias("entropy"))


def cluster_entropy(rows: DataFrame, k: int, classes: int, f: str = "f", label: str = "label", placed: DataFrame | None = None) -> DataFrame:
    """Entropy of the label within k-means clusters, weighted by their sizes and over log(classes). placed: rows that have a cluster already."""
    from pixelloom.operators.cluster import kmeans

    placed = kmeans(rows, k, f)[0] if placed is None else placed
    counts = placed.groupBy("cluster", F.col(label).alias("y")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return counts.withColumn("h", -F.log(p) * F.col("n")).agg((F.sum("h") / F.sum("n") / math.log(classes)).alias("ce"))


def forest_entropy(rows: DataFrame, size: int, classes: int = 2, key: str = "id", f: str = "f", label: str = "label", sample: int = 5_000, trees: int = 10, depth: int = 5) -> DataFrame:
    """(feature, ce): per feature the held-out log loss of a small forest on it alone. All features' forests are fitted side by side, each on
    at most `sample` rows (of lowest hash); rows without a whole vector or with a null label are left out."""
    from pixelloom.functions.forest import Forest
    from pixelloom.operators.trees import held_out_loss, usable

    long = usable(rows, size, f).where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"), F.posexplode(f).alias("node", "x"))
    long = long.select("id", "label", F.col("node").cast("string").alias("node"), F.array("x").alias("f"))
    n = long.where("node = '0'").count()
    losses = held_out_loss(Forest(trees, depth, 2), classes, sample)(long, [{"node": str(k), "n": n} for k in range(size)])
    return rows.sparkSession.createDataFrame(sorted((int(k), v) for k, v in losses.items()), "feature int, ce double")


def pick_channels(energies: DataFrame, pass_on: float, keep: float) -> DataFrame:
    """Channels that go on to the next hop and those that are kept, by two thresholds."""
    return energies.select("k", "energy", (F.col("energy") > pass_on).cast("int").alias("passed"), ((F.col("energy") <= pass_on) & (F.col("energy") > keep)).cast("int").alias("kept"))


def importances(rows: DataFrame, f: str = "f", label: str = "label", trees: int = 20, depth: int = 8):
    """Importances of a forest over all features; features and labels stay together in their rows."""
    from pixelloom.operators.learn import forest

    model = forest(rows, f, label, trees, depth)
    if model.model is None:
        return rows.sparkSession.createDataFrame([], "feature long, importance double")
    values = model.model.featureImportances.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(enumerate(values)), "feature long, importance double")
