"""Scaling and weights. Every global statistic is one scalar subquery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.expr import add, col


def _with_stats(df: DataFrame, fit_on: DataFrame | None, stats: list[Column]) -> DataFrame:
    source = df if fit_on is None else fit_on
    return df.withColumn("_stats", source.agg(F.struct(*stats).alias("stats")).scalar())


def _stat(name: str) -> Column:
    return F.col("_stats").getField(name)


def scale_minmax(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    stats = [x for k, c in enumerate(cols)
             for x in (F.min(col(c)).cast("double").alias(f"a{k}"), F.max(col(c)).cast("double").alias(f"b{k}"))]
    scaled = {c: F.when(_stat(f"b{k}") > _stat(f"a{k}"),
                        (col(c) - _stat(f"a{k}")) / (_stat(f"b{k}") - _stat(f"a{k}")))
              .when(col(c).isNotNull(), F.lit(0.0)) for k, c in enumerate(cols)}
    return _with_stats(df, fit_on, stats).withColumns(scaled).drop("_stats")


def scale_standard(df: DataFrame, cols: Sequence[str], ddof: int = 0, fit_on: DataFrame | None = None) -> DataFrame:
    """Centre and divide by the population (0) or sample (1) deviation; fit on ``fit_on`` if given."""
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = [x for k, c in enumerate(cols)
             for x in (F.avg(col(c)).alias(f"m{k}"), spread(col(c)).alias(f"s{k}"))]
    scaled = {c: (col(c) - _stat(f"m{k}"))
              / F.when(_stat(f"s{k}") > 0, _stat(f"s{k}")).otherwise(F.lit(1.0)) for k, c in enumerate(cols)}
    return _with_stats(df, fit_on, stats).withColumns(scaled).drop("_stats")


def scale_by_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide each column by its maximum over the table."""
    stats = [F.max(col(c)).cast("double").alias(f"x{k}") for k, c in enumerate(cols)]
    scaled = {c: col(c) / F.nullif(_stat(f"x{k}"), F.lit(0.0)) for k, c in enumerate(cols)}
    return _with_stats(df, None, stats).withColumns(scaled).drop("_stats")


def observation_weights(df: DataFrame, variant: str = "noSize", *, ivars: Sequence[str] | None = None,
                        errors: Sequence[str] | None = None, name: str = "weight") -> DataFrame:
    """Row weight from inverse variances (square root) and errors (reciprocal).

    Each term is scaled by its column maximum, the terms are summed, and the sum
    is scaled by its maximum. A zero error (a repaired band) has no finite
    reciprocal and adds nothing.
    """
    ivars = list(S.IVARS if ivars is None else ivars)
    if errors is None:
        errors = S.MAGNITUDE_ERRORS + (S.RADIUS_ERRORS if variant == "wSize" else [])
    terms = [F.when(col(c) >= 0, F.sqrt(col(c))) for c in ivars]
    terms += [F.lit(1.0) / F.nullif(col(c).cast("double"), F.lit(0.0)) for c in errors]
    named = df.withColumns({f"_w{k}": t for k, t in enumerate(terms)})
    top = [F.max(f"_w{k}").alias(f"x{k}") for k in range(len(terms))]
    total = add(F.coalesce(F.col(f"_w{k}") / F.nullif(_stat(f"x{k}"), F.lit(0.0)), F.lit(0.0))
                for k in range(len(terms)))
    summed = _with_stats(named, None, top).withColumn(name, total)
    summed = summed.drop("_stats", *[f"_w{k}" for k in range(len(terms))])
    return scale_by_max(summed, [name])


def power_weight(df: DataFrame, target: str, power: int, name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.pow(col(target), F.lit(float(power))))
