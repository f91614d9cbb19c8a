"""Filters, projections, joins and set operations on catalogue tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.expr import add, all_of, col, peak_name, positive
from ..functions.text import image_object_id


def select_catalogue(
    photo: DataFrame,
    spec: DataFrame,
    cls: str,
    n: int | None = None,
    *,
    photo_key: str = "objid",
    spec_key: str = "bestobjid",
    class_col: str = "class",
    warning_col: str | None = "zWarning",
    columns: Mapping[str, str] | None = None,
    order_by: str = "specObjID",
) -> DataFrame:
    """Photometry of one class joined to its spectroscopy, top ``n`` by ``order_by``.

    ``columns`` maps output names to input names (the SELECT list with renames).
    Both predicates sit on the spectroscopic side, so they reach its scan.
    """
    chosen = spec.where(col(class_col) == cls)
    if warning_col:
        chosen = chosen.where(col(warning_col) == 0)
    joined = photo.join(chosen, photo[photo_key] == chosen[spec_key], "inner")
    if columns:
        joined = joined.select([col(source).alias(name) for name, source in columns.items()])
    return joined if n is None else joined.orderBy(col(order_by)).limit(n)


def all_positive(df: DataFrame, cols: Sequence[str] = S.POSITIVE_COLUMNS) -> DataFrame:
    """Keep rows in which every named column is strictly positive and not NaN."""
    return df.where(all_of(positive(c) for c in cols))


def with_label(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(col(column) == value)


def clip_range(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None,
               closed: str = "none") -> DataFrame:
    """Rows inside a range; ``closed`` is none, left, right or both."""
    if lo is not None:
        df = df.where(col(column) >= lo if closed in ("left", "both") else col(column) > lo)
    if hi is not None:
        df = df.where(col(column) <= hi if closed in ("right", "both") else col(column) < hi)
    return df


def drop_features(df: DataFrame, variant: str = "noSize", extra: Sequence[str] = ()) -> DataFrame:
    """Remove identifiers and errors; ``wSize`` also removes the radius errors."""
    if variant == "samples":
        names = list(S.SAMPLE_TAGS)
    else:
        names = S.BOOKKEEPING + (S.RADIUS_ERRORS if variant == "wSize" else [])
    return df.drop(*names, *extra)


def cluster_features(df: DataFrame, variant: str = "noSize", keep: Sequence[str] = ()) -> DataFrame:
    """The feature table that clustering uses, by name instead of by position."""
    names = {"noSize": S.CLUSTER_NO_SIZE, "wSize": S.CLUSTER_WITH_SIZE, "samples": S.CLUSTER_SAMPLES}[variant]
    return df.select(*[col(c) for c in keep], *[col(c) for c in names])


def peak_label(df: DataFrame, name: str = "label") -> DataFrame:
    return df.withColumn(name, peak_name("singlePeak"))


def normalise_shares(df: DataFrame, cols: Sequence[str] = tuple(S.SAMPLE_SHARES)) -> DataFrame:
    """Divide the columns by their sum; a zero sum gives NULL."""
    total = F.nullif(add(col(c) for c in cols), F.lit(0.0))
    return df.withColumns({c: col(c) / total for c in cols})


def unpivot_curves(df: DataFrame, names: Sequence[str] = tuple(S.CURVE_NAMES), t: str = "t") -> DataFrame:
    """Wide light-curve rows to ``(series_id, t, flux, error)``."""
    pairs = F.array(*[
        F.struct(F.lit(n).alias("series_id"), col(S.flux_column(n)).alias("flux"),
                 col("e_" + S.flux_column(n)).alias("error")) for n in names])
    return df.select(col(t).alias("t"), F.explode(pairs).alias("p")).select("p.series_id", "t", "p.flux", "p.error")


def model_flux(df: DataFrame, components: Sequence[int] | str = "all", name: str = "model_flux") -> DataFrame:
    """Sum of the chosen Gaussian component columns, or the total model column."""
    if components == "all":
        return df.withColumn(name, F.col("MODFLUX"))
    return df.withColumn(name, add(F.col(f"GAUSS{j}") for j in components))


def objects_with_images(df: DataFrame, files: DataFrame, file_col: str = "file", key: str = "specObjID") -> DataFrame:
    """Rows whose id occurs in an image file name.

    Repeated ids are merged before the shuffle, so one id with very many files does no harm.
    """
    ids = files.select(image_object_id(file_col).alias(key)).where(F.col(key).isNotNull()).distinct()
    return df.join(ids, key, "left_semi")


def attach_weights(df: DataFrame, weights: DataFrame, key: str = "row_id", how: str = "inner") -> DataFrame:
    return df.join(weights, key, how)


def attach_clusters(df: DataFrame, assignments: DataFrame, key: str = "row_id") -> DataFrame:
    """Put the cluster number next to the original row and class."""
    return df.join(assignments.select(key, "cluster"), key, "inner")


def combine(frames: Sequence[DataFrame] | Mapping[str, DataFrame], label: str = "class") -> DataFrame:
    """UNION ALL by column name; a mapping also adds its key as a label column."""
    if isinstance(frames, Mapping):
        frames = [f.withColumn(label, F.lit(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), list(frames))


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(col(column)).distinct().orderBy(col(column))


def row_lookup(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The n-th row (from 0) in the given order as name/value pairs."""
    row = df.orderBy(*[col(c) for c in order_cols]).offset(n).limit(1)
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("value")) for c in df.columns])
    return row.select(F.explode(pairs).alias("p")).select("p.name", "p.value")
