"""Equal-width bins and binned sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import col


def bin_equal_width(df: DataFrame, cols: Sequence[str], bins: int = 5) -> DataFrame:
    """Replace columns by bin numbers 1..bins over their own range.

    The maximum falls into the last bin; a constant column into the middle one.
    The limits of all columns are one scalar subquery: one row, one extra pass.
    """
    limits = df.agg(F.struct(*[
        x for k, c in enumerate(cols)
        for x in (F.min(col(c)).cast("double").alias(f"lo{k}"), F.max(col(c)).cast("double").alias(f"hi{k}"))
    ]).alias("limits")).scalar()

    def number(k: int, c: str) -> Column:
        lo, hi = F.col("_limits").getField(f"lo{k}"), F.col("_limits").getField(f"hi{k}")
        width = (hi - lo) / F.lit(float(bins))
        return (F.when(hi > lo, F.least(F.lit(bins).cast("long"), F.floor((col(c) - lo) / width) + 1))
                .when(col(c).isNotNull(), F.lit(bins // 2 + 1).cast("long"))).cast("int")

    return df.withColumn("_limits", limits).withColumns({c: number(k, c) for k, c in enumerate(cols)}).drop("_limits")


def range_bin(x: str | Column, lo: float, hi: float, bins: int, closed: bool = False) -> Column:
    """Bin number 1..bins of (lo, hi] in equal steps, NULL outside; ``closed`` puts ``lo`` itself into the first bin."""
    width = (hi - lo) / bins
    inside = (col(x) >= lo) if closed else (col(x) > lo)
    return F.when(inside & (col(x) <= hi),
                  F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((col(x) - F.lit(lo)) / F.lit(width)).cast("int"))))


def _binned(df: DataFrame, x: str, lo: float, hi: float, bins: int, by: Sequence[str],
            aggregates: dict[str, Column], closed: bool = True) -> DataFrame:
    """Aggregate per (by, bin) and add the empty bins of every group.

    The sums of one group (at most ``bins`` entries) are packed into a map and
    unfolded over all bin numbers, so the input is read once.
    """
    keys = [col(b) for b in by]
    marked = df.withColumn("bin", range_bin(x, lo, hi, bins, closed))
    sums = marked.groupBy(*keys, "bin").agg(*[v.alias(k) for k, v in aggregates.items()])
    entry = F.when(F.col("bin").isNotNull(), F.struct(F.col("bin"), F.struct(*aggregates)))
    packed = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_sums"))
    rows = packed.select(*keys, "_sums", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    found = F.try_element_at("_sums", F.col("bin"))
    width = (hi - lo) / bins
    return rows.select(*keys, "bin", *[found[k].alias(k) for k in aggregates],
                       (F.lit(float(lo)) + (F.col("bin") - 0.5) * F.lit(width)).alias("centre"))


def histogram_sum(df: DataFrame, x: str, w: str | Column, lo: float, hi: float, bins: int,
                  by: Sequence[str] = ()) -> DataFrame:
    """Sum of the weights per bin of a fixed range, limits included; values outside are ignored."""
    return histogram_sums(df, x, {"total": w}, lo, hi, bins, by)


def histogram_sums(df: DataFrame, x: str, sums: Mapping[str, str | Column], lo: float, hi: float, bins: int,
                   by: Sequence[str] = ()) -> DataFrame:
    """Several sums per bin from one pass."""
    out = _binned(df, x, lo, hi, bins, by, {name: F.sum(col(w)) for name, w in sums.items()})
    return out.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in sums})


def binned_weighted_mean(df: DataFrame, x: str, v: str, w: str, lo: float, hi: float, bins: int,
                         by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of ``v`` per bin of ``x``, NULL in empty bins."""
    mean = F.sum(col(v) * col(w)) / F.nullif(F.sum(col(w)).cast("double"), F.lit(0.0))
    return _binned(df, x, lo, hi, bins, by, {"mean": mean}, closed=False)


def binned_ratio(df: DataFrame, x: str, a: str, b: str, lo: float, hi: float, bins: int,
                 by: Sequence[str] = ()) -> DataFrame:
    """Ratio of two binned sums; a zero denominator counts as one."""
    out = histogram_sums(df, x, {"_a": a, "_b": b}, lo, hi, bins, by)
    return out.withColumn("ratio", safe_ratio("_a", "_b")).drop("_a", "_b")


def safe_ratio(a: str, b: str) -> Column:
    return col(a) / F.when(col(b) == 0, F.lit(1.0)).otherwise(col(b))


def transfer_function(df: DataFrame, t: str, w: str, bins: int, t_max: float,
                      by: Sequence[str] = ()) -> DataFrame:
    """Weighted delay histogram scaled to a peak of 1, with its mean delay."""
    hist = histogram_sum(df, t, w, 0.0, t_max, bins, by)
    group = W.partitionBy(*[col(b) for b in by])  # one row per bin
    mean = F.sum(F.col("centre") * F.col("total")).over(group) / F.nullif(F.sum("total").over(group), F.lit(0.0))
    return hist.select(*[col(b) for b in by], "bin", "centre",
                       (F.col("total") / F.nullif(F.max("total").over(group), F.lit(0.0))).alias("psi"),
                       mean.alias("mean_delay"))
