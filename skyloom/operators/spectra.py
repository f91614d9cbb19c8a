"""Spectra, integrated line curves and line-profile measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import col
from ..functions.text import header_number, visit_rank
from ..session import stored
from .binning import range_bin
from .ordering import join_null_safe, ordered
from .selection import clip_range
from .series import ccf_centroid, ccf_peak, cross_correlation, monte_carlo_curves


def visit_order(df: DataFrame, name_col: str) -> DataFrame:
    """Visit files in observing order."""
    return df.withColumn("rank", visit_rank(name_col)).orderBy("rank")


def line_components(df: DataFrame, header_col: str, line: str) -> DataFrame:
    """Numbers of the model components of one line, from the HISTORY cards of a header."""
    card = F.trim(F.col("card"))
    cards = df.withColumn("card", F.explode(F.split(col(header_col), "HISTORY"))).withColumn("card", card)
    broad = F.contains("card", F.lit("Broad")) & ~F.contains("card", F.lit("Broad Absorption"))
    chosen = cards.where(F.startswith("card", F.lit("Gaussian")) & F.contains("card", F.lit(line))
                         & (broad | F.contains("card", F.lit("Bump"))))
    token = F.get(F.split("card", " "), F.lit(2))
    return chosen.withColumn("component", F.regexp_replace(token, "^:+|:+$", "").try_cast("int")).drop("card")


def header_values(df: DataFrame, header_col: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Exposure and start time out of header text."""
    keys = keys or {"exp": "EXPTIME =", "t": "HJDSTART="}
    return df.withColumns({name: header_number(header_col, key) for name, key in keys.items()})


def average_spectrum(df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Mean flux and model and the error of the mean on the union of all wavelengths."""
    chosen = clip_range(df, "lambda", lo, hi)
    return chosen.groupBy("lambda").agg(
        F.avg("flux").alias("flux"),
        (F.sqrt(F.sum(F.col("error") * F.col("error"))) / F.count(F.lit(1))).alias("error"),
        F.avg("model_flux").alias("model_flux"), F.count(F.lit(1)).alias("visits"))


def line_light_curves(
    df: DataFrame,
    dl: float,
    lo: float = 1520.0,
    hi: float = 1646.0,
    cont: Sequence[tuple[float, float]] | None = None,
    *,
    t_stop: float | None = None,
    use_model: bool = True,
    cell: float = 16.0,
) -> DataFrame:
    """Continuum-subtracted line flux per visit and wavelength bin with its error.

    The continuum is the straight line through the mean flux of two side bands.
    Inside a bin neighbouring samples are joined by trapezoids. Visits after the
    first one at or beyond ``t_stop`` are left out. A bin with fewer than two
    samples is 0; a visit without samples in a side band has no continuum, so its
    fluxes are NULL.
    """
    (a0, a1), (b0, b1) = cont or [(lo - 10, lo), (hi, hi + 10)]
    bins = math.ceil((hi - lo) / dl)
    flux = col("model_flux" if use_model else "flux")
    start = df.agg(F.min("t")).scalar()
    rows = df.select("visit", (F.col("t") - start).alias("t"), "lambda", flux.alias("f"), "error")
    if t_stop is not None:
        last = rows.where(F.col("t") >= t_stop).agg(F.min("t")).scalar()
        rows = rows.where(F.col("t") <= F.coalesce(last, F.lit(float("inf"))))
    wave = F.col("lambda")
    bands = rows.groupBy("visit", "t").agg(
        F.avg(F.when((wave > a0) & (wave < a1), F.col("f"))).alias("_f1"),
        F.avg(F.when((wave > b0) & (wave < b1), F.col("f"))).alias("_f2"))
    l1, l2 = (a0 + a1) / 2, (b0 + b1) / 2
    tilt = (F.col("_f2") - F.col("_f1")) / F.lit(l2 - l1)
    lines = bands.select("visit", "t", tilt.alias("_m"), F.col("_f1").alias("_b"))

    binned = rows.drop("t").withColumn("bin", range_bin("lambda", lo, hi, bins)).where(F.col("bin").isNotNull())
    pairs = ordered(binned, ["visit", "bin"], "lambda", cell=cell, previous=["lambda", "f", "error"])
    step = wave - F.col("prev_lambda")
    # the continuum is b + m (wave - l1), so its integral needs only the sums of step and step * (wave - l1)
    sums = pairs.where(F.col("prev_lambda").isNotNull()).groupBy("visit", "bin").agg(
        F.sum(step * (F.col("f") + F.col("prev_f")) / 2).alias("_area"), F.sum(step).alias("_width"),
        F.sum(step * ((wave - F.lit(l1)) + (F.col("prev_lambda") - F.lit(l1))) / 2).alias("_moment"),
        F.sum(F.pow((F.col("error") + F.col("prev_error")) * step / 2, F.lit(2.0))).alias("_e2"))
    grid = lines.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    full = join_null_safe(grid, sums, ["visit", "bin"], "left")
    width = (hi - lo) / bins
    value = F.when(F.col("_area").isNull(), F.lit(0.0)).otherwise(
        F.col("_area") - F.col("_m") * F.col("_moment") - F.col("_b") * F.col("_width"))
    return full.select("visit", "t", "bin", (F.lit(lo) + (F.col("bin") - 0.5) * F.lit(width)).alias("centre"),
                       value.alias("flux"), F.sqrt(F.coalesce("_e2", F.lit(0.0))).alias("error"))


def binned_delays(
    spectra: DataFrame,
    continuum: DataFrame,
    dl: float = 10.0,
    lo: float = 1450.0,
    hi: float = 1730.0,
    *,
    n_mc: int = 1,
    seed: int = 0,
    centroid: bool = True,
    cell: float = 1.0,
    use_model: bool = True,
    cont: Sequence[tuple[float, float]] | None = None,
    **ccf,
) -> DataFrame:
    """Delay of every wavelength bin behind the continuum, averaged over Monte Carlo curves.

    All bins and repeats run side by side, keyed by (bin, mc). Every stage that
    later steps read more than once is written to the shared folder first.
    Fluxes without a continuum (NULL) take no part.
    """
    spectra = stored(spectra.select("visit", "t", "lambda", "flux", "error", "model_flux"), "spectra")
    lines = stored(line_light_curves(spectra, dl, lo, hi, cont, use_model=use_model), "lines")
    repeats = stored(monte_carlo_curves(lines.where("flux IS NOT NULL").select("bin", "t", "flux", "error"), ["bin"], n_mc, seed, cell=cell), "repeats")
    bins = math.ceil((hi - lo) / dl)
    driver = stored(continuum.select("t", "flux"), "continuum").select("t", "flux", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")) \
                      .withColumn("mc", F.explode(F.sequence(F.lit(0), F.lit(n_mc - 1))))
    found = cross_correlation(driver, repeats, ["bin", "mc"], cell=cell, **ccf)
    delays = ccf_centroid(found, ["bin", "mc"]) if centroid else ccf_peak(found, ["bin", "mc"])
    width = (hi - lo) / bins
    return delays.groupBy("bin").agg(F.avg("delay").alias("delay")).withColumn(
        "centre", F.lit(lo) + (F.col("bin") - 0.5) * F.lit(width))


# --- line profiles -------------------------------------------------------------------
# A profile is one row per (model, bin) by construction, so its window is bounded by the bin count.

def normalise_profiles(df: DataFrame, keys: Sequence[str], flux: str = "flux", name: str = "lp") -> DataFrame:
    top = F.max(col(flux)).over(W.partitionBy(*[col(k) for k in keys]))
    return df.withColumn(name, col(flux) / F.nullif(top, F.lit(0.0)))


def tag_profiles(df: DataFrame, keys: Sequence[str], bins: int, bin_col: str = "bin", lp: str = "lp") -> DataFrame:
    """Single or double peaked: does the profile rise again on the way out from its maximum?"""
    buffer = round(bins / 100)
    b, y = col(bin_col), col(lp)
    lit = F.when(y > 0, b)
    whole = W.partitionBy(*[col(k) for k in keys])
    seen = df.withColumns({"_peak": F.max_by(b, F.struct(y, -b)).over(whole), "_lo": F.min(lit).over(whole), "_hi": F.max(lit).over(whole)})
    window = W.partitionBy(*[col(k) for k in keys]).orderBy(b)
    reach = F.least(F.col("_peak") - F.col("_lo"), F.col("_hi") - F.col("_peak")) - buffer
    distance = F.abs(b - F.col("_peak"))
    rise = F.when(b < F.col("_peak"), F.lag(y).over(window) > y).when(b > F.col("_peak"), F.lead(y).over(window) > y) \
            .otherwise((F.lag(y).over(window) > y) | (F.lead(y).over(window) > y))
    flagged = seen.withColumn("_rise", (distance >= buffer) & (distance < reach) & F.coalesce(rise, F.lit(False)))
    out = flagged.groupBy(*[col(k) for k in keys]).agg(F.max("_rise").alias("_double"), F.max(y > 0).alias("_any"))
    shines = F.coalesce(F.col("_any"), F.lit(False))
    return out.select(*[col(k) for k in keys], (shines & ~F.col("_double")).alias("singlePeak"),
                      (shines & F.col("_double")).alias("doublePeak"))


def tag_rotation(df: DataFrame, keys: Sequence[str], v: str = "v", phase: str = "phase", lp: str = "lp") -> DataFrame:
    """Sense of rotation from the mean phase on both sides of the centre, and the phase amplitude."""
    sums = df.groupBy(*[col(k) for k in keys]).agg(
        F.avg(F.when(col(v) < 0, col(phase))).alias("_left"), F.avg(F.when(col(v) > 0, col(phase))).alias("_right"),
        (F.max(col(phase)) - F.min(col(phase))).alias("_amplitude"), F.coalesce(F.max(col(lp) > 0), F.lit(False)).alias("_any"))
    turn = F.when(~F.col("_any"), "none").when(F.col("_left") > F.col("_right"), "ccw").otherwise("cw")
    return sums.select(*[col(k) for k in keys], turn.alias("rotation"),
                       F.when(F.col("_any"), F.col("_amplitude")).otherwise(F.lit(0.0)).alias("phaseAmplitude"))


def fwhm(df: DataFrame, keys: Sequence[str], v: str = "v", lp: str = "lp", bin_col: str = "bin") -> DataFrame:
    """Velocity of the last bin above one half minus that of the first; -1 without flux."""
    above = F.when(col(lp) > 0.5, col(bin_col))
    width = F.max_by(col(v), above) - F.min_by(col(v), above)
    return df.groupBy(*[col(k) for k in keys]).agg(F.coalesce(width, F.lit(-1.0)).alias("FHWM"))


def rescale_phase(df: DataFrame, phase: str = "phase", lp: str = "lp") -> DataFrame:
    """Phase of the line diluted by the continuum: phase * L / (1 + L)."""
    return df.withColumn(phase, col(phase) * col(lp) / (1.0 + col(lp)))
