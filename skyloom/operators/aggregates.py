"""Grouped and global aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.expr import col, credit_line
from .ordering import exact_quantiles


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(col(column)).agg(F.count(F.lit(1)).alias("n")).orderBy(col(column))


def credit_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """Share approved (per cent), mean and total of the credit line."""
    amount = credit_line(score)
    return df.select(amount.alias("amount")).agg(
        (F.avg((F.col("amount") > 0).cast("double")) * 100).alias("approved_pct"),
        F.avg("amount").alias("mean_credit"),
        F.sum("amount").alias("total_credit"),
    )


def sweep_marginals(df: DataFrame, axis: str, measures: Sequence[str], where=None) -> DataFrame:
    """Mean of each measure along one sweep axis, optionally after a filter."""
    chosen = df if where is None else df.where(where)
    return chosen.groupBy(col(axis)).agg(*[F.avg(col(m)).alias(m) for m in measures])


def best_rows(df: DataFrame, measures: Sequence[str], row_id: str) -> DataFrame:
    """For each measure the row with its minimum, the lowest ``row_id`` on ties."""
    row = F.struct(*[col(c) for c in df.columns])
    winners = [
        F.struct(F.lit(m).alias("measure"),
                 F.min_by(row, F.when(col(m).isNotNull() & ~F.isnan(col(m)), F.struct(col(m), col(row_id)))).alias("row"))
        for m in measures
    ]
    return df.agg(F.array(*winners).alias("w")).select(F.explode("w").alias("w")).select("w.measure", "w.row.*")


def weighted_mean(df: DataFrame, x: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of x w over sum of w, NULL where the weights sum to zero."""
    return df.groupBy(*[col(b) for b in by]).agg(
        (F.sum(col(x) * col(w)) / F.nullif(F.sum(col(w)).cast("double"), F.lit(0.0))).alias("weighted_mean"))


def sum_over(df: DataFrame, value: str, by: Sequence[str], name: str = "total") -> DataFrame:
    return df.groupBy(*[col(b) for b in by]).agg(F.sum(col(value)).alias(name))


def mean_over(df: DataFrame, value: str, by: Sequence[str], name: str = "mean") -> DataFrame:
    """Mean over repeats (Monte Carlo draws) of a per-bin result."""
    return df.groupBy(*[col(b) for b in by]).agg(F.avg(col(value)).alias(name))


def box_summary(df: DataFrame, cols: Sequence[str], by: str) -> DataFrame:
    """Minimum, quartiles and maximum of each measure per class, exact at any size."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), col(c).cast("double").alias("value")) for c in cols])
    long = df.select(col(by), F.explode(pairs).alias("p")).select(col(by), "p.measure", "p.value")
    names = {"lowest": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "highest": 1.0}
    found = exact_quantiles(long, [by, "measure"], "value", list(names.values()))
    return found.groupBy(col(by), "measure").agg(
        *[F.max(F.when(F.col("fraction") == q, F.col("quantile"))).alias(n) for n, q in names.items()])


def pivot_scores(df: DataFrame, row: str, column: str, score: str = "score", values: Sequence | None = None) -> DataFrame:
    """Score table in per cent with one row per ``row`` and one column per ``column``."""
    return df.groupBy(col(row)).pivot(column, list(values) if values else None).agg(F.max(col(score) * 100))
