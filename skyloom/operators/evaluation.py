"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import col
from .ordering import full_grid


def confusion_matrix(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """Counts for every pair of labels, empty cells included, and their share of the largest cell."""
    counts = df.groupBy(col(truth).alias("truth"), col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = full_grid(counts, "truth", "predicted", same_labels=True)
    return grid.withColumn("share", F.col("n") / F.max("n").over(W.partitionBy()))  # labels x labels rows


def accuracy(df: DataFrame, truth: str = "label", predicted: str = "prediction", weight: str | None = None) -> DataFrame:
    """Share of hits, weighted if a weight column is given."""
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    hit = F.coalesce((col(truth) == col(predicted)).cast("double"), F.lit(0.0))
    return df.select((w * hit).alias("_h"), w.alias("_w")).agg(
        (F.sum("_h") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("accuracy"))


def r2(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """1 minus residual over total sum of squares (can be negative)."""
    residual = F.sum(F.pow(col(truth) - col(predicted), F.lit(2.0)))
    total = F.var_pop(col(truth)) * F.count(F.lit(1))
    return df.agg((1.0 - residual / F.nullif(total, F.lit(0.0))).alias("r2"))


def mae_by_class(df: DataFrame, truth: str, predicted: str, cls: str) -> DataFrame:
    """Mean absolute error per class plus one row ``ALL``, and the error relative to the mean target."""
    per_class = df.groupBy(col(cls).cast("string").alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.abs(col(truth) - col(predicted))).alias("_e"), F.sum(col(truth)).alias("_y"))
    both = per_class.withColumn("group", F.explode(F.array("_c", F.lit("ALL"))))
    return both.groupBy("group").agg(
        F.sum("_n").alias("n"), (F.sum("_e") / F.sum("_n")).alias("mae"), (F.sum("_y") / F.sum("_n")).alias("mean_target"))


def relative_error(df: DataFrame, truth: str, predicted: str, cls: str) -> DataFrame:
    scored = mae_by_class(df, truth, predicted, cls)
    return scored.withColumn("relative_error", F.col("mae") / F.nullif("mean_target", F.lit(0.0)))
