"""Repair of radius measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.expr import add, col
from .selection import all_positive


def bad_bands(df: DataFrame, errors: Sequence[str] = S.RADIUS_ERRORS, name: str = "n_bad") -> DataFrame:
    """Per row the number of bands whose error carries the negative sentinel."""
    return df.withColumn(name, add(F.coalesce((col(e) < 0).cast("int"), F.lit(0)) for e in errors))


def repair_sizes(
    df: DataFrame,
    max_bad: int = 2,
    dim: float = 0.1,
    *,
    magnitudes: Sequence[str] = S.BANDS,
    radii: Sequence[str] = S.RADII,
    errors: Sequence[str] = S.RADIUS_ERRORS,
) -> DataFrame:
    """Zero the radius and error of bad bands in rows where those bands are dim.

    More than ``max_bad`` bad bands drop the row, as do bad bands that hold
    ``dim`` or more of the summed magnitudes. Rows without bad bands stay.
    """
    bad = {e: F.coalesce(col(e) < 0, F.lit(False)) for e in errors}
    count = add(b.cast("int") for b in bad.values())
    bad_light = add(F.when(bad[e], col(m)).otherwise(F.lit(0.0)) for m, e in zip(magnitudes, errors))
    all_light = F.nullif(add(col(m).cast("double") for m in magnitudes), F.lit(0.0))
    keep = (count == 0) | ((count <= max_bad) & (bad_light / all_light < dim))
    zeroed = {}
    for r, e in zip(radii, errors):
        zeroed[r] = F.when(bad[e], F.lit(0.0)).otherwise(col(r))
        zeroed[e] = F.when(bad[e], F.lit(0.0)).otherwise(col(e))
    return df.where(keep).withColumns(zeroed)


def clean(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The masked catalogue without sizes, and with repaired sizes."""
    masked = all_positive(df)
    return masked.drop(*S.RADII, *S.RADIUS_ERRORS), repair_sizes(masked)
