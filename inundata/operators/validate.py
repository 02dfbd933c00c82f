"""Accuracy of a flood map against a reference map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compared(truth: DataFrame, prediction: DataFrame, aoi: DataFrame | None = None, on: tuple[str, ...] = ("row", "col"), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, truth, pred (0/1) where the area is inside and the prediction is not missing.

    Keys (area, event) are columns of all inputs; pixels meet within theirs.
    """
    on = (*keys, *on)
    joined = truth.select(*on, F.col("value").alias("t")).join(prediction.select(*on, F.col("value").alias("p")), list(on))
    if aoi is not None:
        joined = joined.join(aoi.where("value > 0").select(*on), list(on), "left_semi")
    flag = lambda c: F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
    return joined.where("p is not null").select(*keys, flag("t").alias("truth"), flag("p").alias("pred"))


def confusion_matrix(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and four counts: c00, c01, c10, c11 (truth, prediction); without keys one row."""
    return pairs.groupBy(*keys).agg(*[F.count_if((F.col("truth") == t) & (F.col("pred") == p)).alias(f"c{t}{p}") for t in (0, 1) for p in (0, 1)])


def accuracy_metrics(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, accuracy, precision, recall, f1, kappa; NULL where a class is absent."""
    c = {k: F.col(k).cast("double") for k in ("c00", "c01", "c10", "c11")}
    n = c["c00"] + c["c01"] + c["c10"] + c["c11"]
    precision, recall = F.try_divide(c["c11"], c["c01"] + c["c11"]), F.try_divide(c["c11"], c["c10"] + c["c11"])
    po = F.try_divide(c["c00"] + c["c11"], n)
    pe = F.try_divide((c["c00"] + c["c01"]) * (c["c00"] + c["c10"]) + (c["c10"] + c["c11"]) * (c["c01"] + c["c11"]), n * n)
    return confusion_matrix(pairs, keys).select(
        *keys, po.alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(po - pe, 1 - pe).alias("kappa")
    )


def confusion_percent(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, truth, pred, n, percent of the keys' total."""
    counts = pairs.groupBy(*keys, "truth", "pred").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*keys)))
