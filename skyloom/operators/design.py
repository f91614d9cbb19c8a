"""Parameter tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions.expr import uniform


def uniform_design(ids: DataFrame, key: str, ranges: Mapping[str, tuple[float, float]] = S.PARAMETER_RANGES,
                   seed: int = 0) -> DataFrame:
    """One uniform random point per id; every axis draws from a hash of its own name."""
    return ids.select(F.col(key), *[
        (F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * uniform(key, f"{seed}/{name}")).alias(name)
        for name, (lo, hi) in ranges.items()])


def param_grid(spark: SparkSession, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the axes, decoded from one row number.

    The last axis varies fastest. The rows are generated in parallel and no
    join is involved.
    """
    total = prod(len(v) for v in axes.values())
    out, stride = [], total
    for name, values in axes.items():
        stride //= len(values)
        digit = F.floor(F.col("id") / F.lit(stride)) % len(values)
        out.append(F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int")).alias(name))
    return spark.range(total).select(F.col("id").alias("grid_id"), *out)


def label_grid(labels: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the distinct labels of every column with the values of the axes.

    The label sets come from one aggregate of the table and are unfolded from
    its one row, without a join and without a collect. NULL is no label.
    """
    sets = labels.agg(*[F.collect_set(F.col(f"`{c}`")).alias(c) for c in labels.columns])
    for name in labels.columns:
        sets = sets.withColumn(name, F.explode(F.col(f"`{name}`")))
    for name, values in axes.items():
        sets = sets.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return sets


def points_per_axis(n: int, axes: int) -> int:
    """Largest p with p ** axes <= n."""
    p = 1
    while (p + 1) ** axes <= n:
        p += 1
    return p


def grid_design(spark: SparkSession, n: int, ranges: Mapping[str, tuple[float, float]] = S.PARAMETER_RANGES,
                seed: int = 0) -> DataFrame:
    """Regular grid with at most n points; fewer than two per axis means a random design of n points."""
    p = points_per_axis(n, len(ranges))
    if p < 2:
        return uniform_design(spark.range(n).withColumnRenamed("id", "grid_id"), "grid_id", ranges, seed)
    axes = {name: [lo + (hi - lo) * k / (p - 1) for k in range(p)] for name, (lo, hi) in ranges.items()}
    return param_grid(spark, axes)
