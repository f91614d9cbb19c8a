"""Scalar column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

LIGHT_SPEED_KM_S = 3e5  # fixed value


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def positive(c: str | Column) -> Column:
    """Strictly positive; NaN is not positive (Spark sorts NaN above every number)."""
    return (col(c) > 0) & ~F.isnan(col(c))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, list(conditions))


def add(terms) -> Column:
    return reduce(lambda a, b: a + b, list(terms))


def dominant(cols: list[str], labels: list[str] | None = None) -> Column:
    """Label of the largest column, the first one when several tie."""
    values = F.array(*[col(c).cast("double") for c in cols])
    names = F.array(*[F.lit(v) for v in (labels or cols)])
    return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))


def inclination_level(c: str | Column) -> Column:
    """Under 30 low, strictly between 30 and 60 medium, everything else (30 too) high."""
    return (F.when(col(c) < 30, "low_i")
            .when((col(c) > 30) & (col(c) < 60), "med_i")
            .otherwise("high_i"))


def distance_level(c: str | Column) -> Column:
    return F.when(col(c) < 1, "close").otherwise("far")


def class_code(c: str | Column) -> Column:
    return F.when(col(c) == "QSO", 0).when(col(c) == "GALAXY", 1).otherwise(2)


def credit_line(score: str | Column) -> Column:
    """Piecewise linear credit: nothing up to a score of 3, then 500 per point."""
    return F.greatest(F.lit(0), 500 * col(score) - 1500)


def peak_name(single: str | Column) -> Column:
    return F.when(col(single), "singlePeak").otherwise("doublePeak")


def rest_wavelength(nu: str | Column, centre: float) -> Column:
    return F.lit(float(centre)) / col(nu)


def velocity(nu: str | Column) -> Column:
    return (col(nu) - 1.0) * F.lit(LIGHT_SPEED_KM_S)


def rest_frame_time(t: str | Column, z: float) -> Column:
    return col(t) / F.lit(1.0 + z)


def keyed_hash(key: str | Column | Sequence[str | Column], seed: int | str) -> Column:
    """60-bit hash of a key (or of several, one after another) and a seed.

    The leading digits of the MD5 of ``seed:key``: seeds, axes and repeats give
    streams that have nothing in common, any SQL engine computes the same
    value, and a draw depends on neither partitioning nor retries.
    """
    keys = [key] if isinstance(key, (str, Column)) else list(key)
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def uniform(key: str | Column | Sequence[str | Column], seed: int | str) -> Column:
    """Uniform draw in (0, 1), of 52 bits, that depends only on the key and the seed."""
    return (F.shiftright(keyed_hash(key, seed), 8).cast("double") + 0.5) / float(1 << 52)


def gaussian(key: str | Column | Sequence[str | Column], seed: int | str) -> Column:
    """Standard normal draw by the Box-Muller transform of two independent keyed uniforms."""
    radius = F.sqrt(-2.0 * F.log(uniform(key, f"{seed}/radius")))
    return radius * F.cos(F.lit(6.283185307179586) * uniform(key, f"{seed}/angle"))
