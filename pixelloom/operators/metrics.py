"""Evaluation metrics as aggregations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per pair, and the share of the label's rows (the diagonal's are recalls)."""
    per = rows.groupBy(label, prediction).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


def binary_scores(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Matthews correlation and F1 of labels 0 and 1; 0 where a denominator is 0."""
    def count(y: int, p: int):
        return F.sum(((F.col(label) == y) & (F.col(prediction) == p)).cast("double"))

    c = rows.agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))
    root = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    mcc = F.when(root == 0, 0.0).otherwise((F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / root)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return c.select(mcc.alias("mcc"), f1.alias("f1"))


def roc_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Exact area by rank sums, ties at half; null with a single class. Rows are counted per score first; distinct scores are dealt by range,
    and a range's negatives are added up before those of the next."""
    from pixelloom.operators.ranks import running_before

    per = rows.groupBy(F.col(score).alias("_s")).agg(F.sum(label).cast("double").alias("_p"), F.sum(1 - F.col(label)).cast("double").alias("_q"))
    pairs = F.sum("_p") * F.sum("_q")
    return running_before(per, "_s", "_q", "_b").agg(F.when(pairs > 0, F.sum(F.col("_p") * (F.col("_b") + F.col("_q") / 2)) / pairs).alias("auc"))


def log_loss(rows: DataFrame, label: str = "label", probability: str = "p", classes: int | None = None, tiny: float = 1e-15) -> DataFrame:
    """Mean -ln of the label's probability; `probability` is that of label 1, or an array by class. With classes over their log."""
    array = dict(rows.dtypes)[probability].startswith("array")
    p = F.get(probability, F.col(label).cast("int")) if array else F.when(F.col(label) == 1, F.col(probability)).otherwise(1 - F.col(probability))
    scale = math.log(classes) if classes else 1.0
    return rows.agg((F.avg(-F.log(F.least(F.lit(1 - tiny), F.greatest(F.lit(tiny), p)))) / scale).alias("log_loss"))


def squared_error(rows: DataFrame, y: str = "y", prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    e = (F.col(y) - F.col(prediction)) ** 2
    return rows.agg((F.sum(e * F.col(weight)) / F.sum(weight) if weight else F.avg(e)).alias("mse"))


def reconstruction_error(rows: DataFrame, a: str = "f", b: str = "g") -> DataFrame:
    """Mean absolute difference of two arrays."""
    pairs = rows.select(F.explode(F.zip_with(a, b, lambda x, y: F.abs(x - y))).alias("e"))
    return pairs.agg(F.avg("e").alias("error"))


def energy_retained(energies: DataFrame, *by: str) -> DataFrame:
    """Running percentage of energy over the channels."""
    w = Window.partitionBy(*by)
    running = F.sum("energy").over(w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return energies.withColumn("retained", 100 * running / F.sum("energy").over(w))
