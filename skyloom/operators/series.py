"""Light curves: rebasing, interpolation, convolution, correlation and Monte Carlo curves.

A series is a set of rows ``(keys..., t, flux[, error])``. Long series are cut
into cells or blocks (see :mod:`skyloom.operators.ordering`), so no operator
needs a whole series in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import add, col, gaussian, rest_frame_time, uniform
from ..schemas import flux_column
from ..session import stored
from .ordering import attach, explode_range, join_null_safe, ordered, over_blocks
from .selection import clip_range


def light_curve(df: DataFrame, name: str, t_stop: float | None = 75.0) -> DataFrame:
    """One curve of the wide table with its error, from the first visit to ``t_stop``."""
    flux = flux_column(name)
    start = df.agg(F.min("t")).scalar()
    curve = df.select((F.col("t") - start).alias("t"), col(flux).alias("flux"), col("e_" + flux).alias("error"))
    return clip_range(curve, "t", hi=t_stop)


def rebase(df: DataFrame, keys: Sequence[str], t: str = "t", t_stop: float | None = None) -> DataFrame:
    """Times relative to the first row of each series, optionally only before ``t_stop``."""
    moved = attach(df, keys, _t0=F.min(col(t))).withColumn(t, col(t) - F.col("_t0")).drop("_t0")
    return clip_range(moved, t, hi=t_stop)


def normalise_curve(df: DataFrame, keys: Sequence[str], t: str = "t", flux: str = "flux") -> DataFrame:
    """Divide by the maximum, subtract the first value, divide by the span of the scaled curve."""
    f = col(flux)
    stats = attach(df, keys, _hi=F.max(f), _lo=F.min(f), _first=F.min_by(f, col(t)))
    top = F.nullif("_hi", F.lit(0.0))
    span = F.nullif((F.col("_hi") - F.col("_lo")) / top, F.lit(0.0))
    return stats.withColumn(flux, (f / top - F.col("_first") / top) / span).drop("_hi", "_lo", "_first")


# --- interpolation -----------------------------------------------------------

def _segments(knots: DataFrame, keys: Sequence[str], x: str, y: str, cell: float, *, rebased: bool = False,
              z: float = 0.0) -> DataFrame:
    """Straight pieces between neighbouring knots: start, slope and whether they end the series.

    ``rebased`` moves the first knot to the origin and divides ``x`` by 1 + z.
    The pieces are written to the shared folder, because several steps read them.
    """
    near = ordered(knots, keys, x, cell=cell, following=[x, y], first=[x, y] if rebased else [], index="_k", size="_n")
    x0 = F.col(f"first_{x}") if rebased else F.lit(0.0)
    y0 = F.col(f"first_{y}") if rebased else F.lit(0.0)
    slope = (F.col(f"next_{y}") - col(y)) / F.nullif(rest_frame_time(F.col(f"next_{x}") - col(x), z), F.lit(0.0))
    return stored(near.where(F.col(f"next_{x}").isNotNull() | (F.col("_n") == 1)).select(
        *[col(k) for k in keys], rest_frame_time(col(x) - x0, z).alias("_x0"), (col(y) - y0).alias("_y0"),
        F.coalesce(slope, F.lit(0.0)).alias("_slope"), rest_frame_time(F.col(f"next_{x}") - x0, z).alias("_x1"), "_n",
        (F.col("_k") == 1).alias("_begins"), ((F.col("_k") == F.col("_n") - 1) | (F.col("_n") == 1)).alias("_ends")), "segments")


def interpolate(knots: DataFrame, queries: DataFrame, keys: Sequence[str], x: str = "t", y: str = "flux", *,
                cell: float = 1.0) -> DataFrame:
    """Linear interpolation of the knots at the query points, extended by the end segments.

    Each query takes the last segment that starts at or before it. That is a
    running value inside a (series, cell) group; the value that enters a cell
    comes from the cell summaries.
    """
    ks = [col(k) for k in keys]
    extra = [c for c in queries.columns if c not in keys]
    pieces = _segments(knots, keys, x, y, cell).select(*ks, F.col("_x0").alias("_pos"), F.struct("_x0", "_y0", "_slope").alias("_seg"))
    points = queries.select(*ks, col(x).alias("_pos"), F.struct(*[col(c) for c in extra]).alias("_row"))
    both = pieces.unionByName(points, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_pos") / F.lit(float(cell))))
    at = F.when(F.col("_seg").isNotNull(), F.col("_pos"))
    cells = both.groupBy(*ks, "_cell").agg(F.max_by("_seg", at).alias("_last"), F.min_by("_seg", at).alias("_head"))
    by_cell = W.partitionBy(*ks).orderBy("_cell")
    entering = F.last("_last", ignorenulls=True).over(by_cell.rowsBetween(W.unboundedPreceding, -1))
    opening = F.first("_head", ignorenulls=True).over(by_cell.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    edges = cells.select(*ks, "_cell", F.coalesce(entering, opening).alias("_in"))
    inside = W.partitionBy(*ks, "_cell").orderBy("_pos", F.col("_row").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    seg = F.coalesce(F.last("_seg", ignorenulls=True).over(inside), F.col("_in"))
    found = join_null_safe(both, edges, [*keys, "_cell"]).withColumn("_s", seg).where(F.col("_row").isNotNull())
    value = F.col("_s._y0") + F.col("_s._slope") * (F.col("_pos") - F.col("_s._x0"))
    return found.select(*ks, *[F.col("_row").getField(c).alias(c) for c in extra], value.alias(y))


def _grid(segments: DataFrame, keys: Sequence[str], factor: int) -> DataFrame:
    """Uniform grid of ``factor`` times as many points as the series, one row per series."""
    spec = segments.groupBy(*[col(k) for k in keys]).agg(
        F.min("_x0").alias("_g0"), F.max(F.coalesce("_x1", "_x0")).alias("_g1"), (F.max("_n") * factor).alias("_m"))
    step = F.coalesce((F.col("_g1") - F.col("_g0")) / F.nullif(F.col("_m") - 1, F.lit(0).cast("long")), F.lit(0.0))
    return spec.withColumn("_step", step).drop("_g1")


def _fill_grid(segments: DataFrame, grid: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Values on the grid points, generated from the segments that cover them (no as-of join)."""
    joined = join_null_safe(segments.drop("_n"), grid, keys)

    def first_at_or_after(edge):
        place = F.ceil((F.col(edge) - F.col("_g0")) / F.nullif("_step", F.lit(0.0)) - 1e-9)
        return F.coalesce(F.greatest(F.lit(0).cast("long"), F.least(F.col("_m"), place)), F.lit(0).cast("long"))

    low = F.when(F.col("_begins"), F.lit(0).cast("long")).otherwise(first_at_or_after("_x0"))
    high = F.when(F.col("_ends"), F.col("_m") - 1).otherwise(first_at_or_after("_x1") - 1)
    rows = explode_range(joined, low, high, "_j")
    return rows.withColumn(name, F.col("_y0") + F.col("_slope") * (F.col("_g0") + F.col("_j") * F.col("_step") - F.col("_x0"))) \
               .drop("_x0", "_y0", "_slope", "_x1", "_begins", "_ends")


def resample(df: DataFrame, keys: Sequence[str], factor: int = 100, x: str = "t", y: str = "flux", *,
             cell: float = 1.0) -> DataFrame:
    """The series on ``factor * n`` equally spaced points between its ends; ``j`` numbers them from 0."""
    pieces = _segments(df, keys, x, y, cell)
    out = _fill_grid(pieces, _grid(pieces, keys, factor), keys, y)
    return out.select(*[col(k) for k in keys], F.col("_j").alias("j"),
                      (F.col("_g0") + F.col("_j") * F.col("_step")).alias(x), col(y))


# --- synthetic curves ----------------------------------------------------------

def synthetic_curve(df: DataFrame, keys: Sequence[str], t: str = "t", flux: str = "flux", psi: str = "psi", *,
                    t_stop: float = 75.0, cell: float = 1.0, block: int = 1 << 18) -> DataFrame:
    """Causal convolution of a continuum curve with a response, scaled to a span of 1.

    Output i sums psi[i - k + 1] * change[k] * step[k] over k <= i; for the last
    row every term takes the last step. Both factors are cut into long blocks,
    every pair of blocks is convolved by one product of transforms that returns
    sums per output position, and Spark adds those.
    """
    ks = [col(k) for k in keys]
    near = ordered(clip_range(df, t, hi=t_stop), keys, t, cell=cell, previous=[t], following=[t], index="_i", size="_n")
    stats = attach(near, keys, _p=F.max(col(psi)), _hi=F.max(col(flux)), _lo=F.min(col(flux)), _f0=F.min_by(col(flux), col(t)))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    step = F.coalesce(F.col(f"next_{t}") - col(t), col(t) - F.col(f"prev_{t}"), F.lit(0.0))
    rows = stored(stats.select(*ks, col(t).alias("t"), "_i", "_n", step.alias("_step"),
                               F.coalesce((col(flux) - F.col("_f0")) / span, F.lit(0.0)).alias("change"),
                               (col(psi) / F.nullif("_p", F.lit(0.0))).alias("_psi")), "synthetic")
    home = F.floor((F.col("_i") - 1) / block)
    mates = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block) - home)
    base = rows.select(*ks, "_i", "_n", "_step", "change", "_psi", home.alias("_h"), F.explode(mates).alias("_o"))
    sides = base.select("*", F.lit(True).alias("_left"), F.col("_h").alias("_a"), F.col("_o").alias("_b")).unionByName(
        base.select("*", F.lit(False).alias("_left"), F.col("_o").alias("_a"), F.col("_h").alias("_b")))

    names = list(keys)

    def convolve(pdf):
        import numpy as np
        import pandas as pd

        left, right = pdf[pdf["_left"]].sort_values("_i"), pdf[~pdf["_left"]].sort_values("_i")
        change, response = left["change"].to_numpy(), right["_psi"].to_numpy()
        n = len(change) + len(response) - 1
        wave = np.fft.rfft(response, n)
        part = np.fft.irfft(np.fft.rfft(change * left["_step"].to_numpy(), n) * wave, n)
        plain = np.fft.irfft(np.fft.rfft(change, n) * wave, n)
        place = int(left["_i"].iloc[0]) + int(right["_i"].iloc[0]) - 1 + np.arange(len(part))
        n = int(left["_n"].iloc[0])
        out = pd.DataFrame({"_i": place, "_part": part, "_tail": np.where(place == n, plain, 0.0)})
        out = out[out["_i"] <= n]
        for k in names:
            out[k] = [pdf[k].iloc[0]] * len(out)
        return out[[*names, "_i", "_part", "_tail"]]

    key_types = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in names)
    parts = sides.groupBy(*ks, "_a", "_b").applyInPandas(
        convolve, (key_types + ", " if names else "") + "_i long, _part double, _tail double")
    sums = parts.groupBy(*ks, "_i").agg(F.sum("_part").alias("_part"), F.sum("_tail").alias("_tail"))
    joined = join_null_safe(rows, sums, [*keys, "_i"])
    raw = joined.withColumn("synthetic", F.when(F.col("_i") == F.col("_n"), F.col("_tail") * F.col("_step")).otherwise(F.col("_part")))
    limits = attach(stored(raw.select(*ks, "t", "change", "synthetic"), "synthetic"), keys, _hi=F.max("synthetic"), _lo=F.min("synthetic"))
    return limits.select(*ks, "t", "change",
                         (F.col("synthetic") / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))).alias("synthetic"))


def match_scale(model: DataFrame, data: DataFrame, keys: Sequence[str], t: str = "t", flux: str = "flux",
                value: str = "synthetic") -> DataFrame:
    """Rescale a model curve of span 1 to the span and first value of the data."""
    span = F.max(col(flux)) - F.min(col(flux))
    stats = data.groupBy(*[col(k) for k in keys]).agg(span.alias("_span"), F.min_by(col(flux), col(t)).alias("_first"))
    return join_null_safe(model, stats, keys).withColumn(value, col(value) * F.col("_span") + F.col("_first")).drop("_span", "_first")


# --- cross-correlation -----------------------------------------------------------

def cross_correlation(
    u: DataFrame,
    v: DataFrame,
    keys: Sequence[str],
    *,
    lags: tuple[float, float] | Sequence[int] | None = None,
    z: float = 0.0,
    t_range: tuple[float, float] | None = None,
    factor: int = 100,
    shared_times: bool = False,
    cell: float = 1.0,
    block: int = 65536,
) -> DataFrame:
    """Correlation of two curves per series at integer lags of a uniform grid.

    Both curves are put on the grid of ``u`` and, unless ``shared_times`` says
    the sampling is the same, also on the grid of ``v``; the results are
    averaged. ``lags`` is a pair of numbers (a time window), a list of one or of
    more than two grid offsets, or None for +-min(m - 1, 10 log10 m). Values are centred and divided
    by the energy of the whole series, which makes a maximum scaling irrelevant.

    A task holds one block of the grid and a halo as wide as the lags. It
    returns partial sums per lag, all lags from one product of transforms, so
    pairs of points are never materialised.
    """
    names = list(keys)
    ks = [col(k) for k in names]

    def pieces_of(df: DataFrame) -> DataFrame:
        if t_range is None:
            return _segments(df.select(*ks, "t", "flux"), names, "t", "flux", cell, rebased=True, z=z)
        moved = attach(df.select(*ks, "t", "flux"), names, _t0=F.min("t"), _f0=F.min_by("flux", "t"))
        moved = moved.select(*ks, rest_frame_time(F.col("t") - F.col("_t0"), z).alias("t"), (F.col("flux") - F.col("_f0")).alias("flux"))
        return _segments(clip_range(moved, "t", *t_range), names, "t", "flux", cell)

    pieces = [pieces_of(u), pieces_of(v)]
    sides = []
    for number, c in enumerate(pieces[:1] if shared_times else pieces):
        grid = _grid(c, names, factor)
        if lags is None:
            reach = F.least(F.col("_m") - 1, F.floor(10 * F.log10(F.col("_m").cast("double"))))
            grid = grid.withColumns({"_lag_lo": -reach, "_lag_hi": reach})
        elif len(lags) == 2:
            step = F.nullif("_step", F.lit(0.0))
            grid = grid.withColumns({
                "_lag_lo": F.greatest(1 - F.col("_m"), F.coalesce(F.ceil(F.lit(float(lags[0])) / step - 1e-9), F.lit(0).cast("long"))),
                "_lag_hi": F.least(F.col("_m") - 1, F.coalesce(F.floor(F.lit(float(lags[1])) / step + 1e-9), F.lit(0).cast("long")))})
        else:
            grid = grid.withColumns({"_lag_lo": F.lit(min(lags)).cast("long"), "_lag_hi": F.lit(max(lags)).cast("long")})
        for which, p in enumerate(pieces):
            filled = _fill_grid(p, grid, names, "_y")
            if which == 0:
                reached = F.array(F.floor(F.col("_j") / block))
            else:  # every block whose points this one can meet, its own block included
                reached = F.sequence(
                    F.floor(F.greatest(F.lit(0).cast("long"), F.col("_j") - F.greatest("_lag_hi", F.lit(0).cast("long"))) / block),
                    F.floor(F.least(F.col("_m") - 1, F.col("_j") - F.least("_lag_lo", F.lit(0).cast("long"))) / block))
            sides.append(filled.select(*ks, F.lit(number).alias("_g"), F.lit(which).alias("_side"), "_j", "_y", "_m", "_step",
                                       "_lag_lo", "_lag_hi", F.explode(reached).alias("_block")))
    points = sides[0]
    for s in sides[1:]:
        points = points.unionByName(s)

    def partial(pdf):
        import numpy as np
        import pandas as pd

        a, b = pdf[pdf["_side"] == 0], pdf[pdf["_side"] == 1]
        if a.empty:
            return pd.DataFrame(columns=[*names, "_g", "_step", "_m", "lag_index", "dot", "sa", "sb", "n", "ta", "taa", "tb", "tbb"])
        head = a.iloc[0]
        m, lo, hi, start = int(head["_m"]), int(head["_lag_lo"]), int(head["_lag_hi"]), int(head["_block"]) * block
        stop = min(start + block, m)
        x = np.zeros(stop - start)
        x[a["_j"].to_numpy() - start] = a["_y"].to_numpy()
        left, right = max(0, start + min(lo, 0)), min(m, stop + max(hi, 0))
        y = np.zeros(right - left)
        where = b["_j"].to_numpy() - left
        inside = (where >= 0) & (where < len(y))
        y[where[inside]] = b["_y"].to_numpy()[inside]
        own = y[start - left:stop - left]
        lag = np.arange(lo, hi + 1)
        first, last = np.maximum(start, -lag), np.minimum(stop, m - lag)
        last = np.maximum(first, last)
        size = 1 << (len(x) + len(y)).bit_length()
        every = np.fft.irfft(np.conj(np.fft.rfft(x, size)) * np.fft.rfft(y, size), size)  # all lags by one product
        sx, sy = np.r_[0.0, np.cumsum(x)], np.r_[0.0, np.cumsum(y)]
        some = last > first
        out = pd.DataFrame({"lag_index": lag, "dot": np.where(some, every[(lag + start - left) % size], 0.0),
                            "sa": np.where(some, sx[np.clip(last - start, 0, len(x))] - sx[np.clip(first - start, 0, len(x))], 0.0),
                            "sb": np.where(some, sy[np.clip(last + lag - left, 0, len(y))] - sy[np.clip(first + lag - left, 0, len(y))], 0.0),
                            "n": np.where(some, last - first, 0)})
        out["ta"], out["taa"], out["tb"], out["tbb"] = x.sum(), x @ x, own.sum(), own @ own
        out["_g"], out["_step"], out["_m"] = int(head["_g"]), float(head["_step"]), m
        for k in names:
            out[k] = [head[k]] * len(out)
        return out[[*names, "_g", "_step", "_m", "lag_index", "dot", "sa", "sb", "n", "ta", "taa", "tb", "tbb"]]

    key_types = "".join(f"`{k}` {points.schema[k].dataType.simpleString()}, " for k in names)
    sums = points.groupBy(*ks, "_g", "_block").applyInPandas(
        partial, key_types + "_g int, _step double, _m long, lag_index long, dot double, sa double, sb double, n long, "
                             "ta double, taa double, tb double, tbb double")
    if lags is not None and len(lags) != 2:
        sums = sums.where(F.col("lag_index").isin([int(x) for x in lags]))
    total = sums.groupBy(*ks, "_g", "lag_index").agg(
        F.first("_step").alias("_step"), F.first("_m").alias("_m"),
        *[F.sum(c).alias(c) for c in ("dot", "sa", "sb", "n", "ta", "taa", "tb", "tbb")])
    ma, mb = F.col("ta") / F.col("_m"), F.col("tb") / F.col("_m")
    energy = (F.col("taa") - F.col("ta") * ma) * (F.col("tbb") - F.col("tb") * mb)
    r = (F.col("dot") - mb * F.col("sa") - ma * F.col("sb") + F.col("n") * ma * mb) / F.nullif(
        F.sqrt(F.greatest(energy, F.lit(0.0))), F.lit(0.0))
    return total.select(*ks, "lag_index", (F.col("lag_index") * F.col("_step")).alias("lag"), r.alias("r")) \
                .groupBy(*ks, "lag_index").agg(F.avg("lag").alias("lag"), F.avg("r").alias("r"))


def ccf_peak(ccf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the largest correlation, the first one on ties."""
    return ccf.groupBy(*[col(k) for k in keys]).agg(
        F.max_by("lag", F.struct("r", -F.col("lag_index"))).alias("delay"))


def ccf_centroid(ccf: DataFrame, keys: Sequence[str], cut: float = 0.8) -> DataFrame:
    """Correlation-weighted mean lag over correlations above ``cut`` times the maximum.

    One row per series. The delay is null where no correlation is positive: the
    weights would change their sign, and no lag is above the cut.
    """
    top = F.max("r").over(W.partitionBy(*[col(k) for k in keys]))  # one row per lag
    near = (F.col("_top") > 0) & (F.col("r") > F.lit(float(cut)) * F.col("_top"))
    return ccf.withColumn("_top", top).groupBy(*[col(k) for k in keys]).agg(
        (F.sum(F.when(near, F.col("r") * F.col("lag"))) / F.nullif(F.sum(F.when(near, F.col("r"))), F.lit(0.0))).alias("delay"))


# --- Monte Carlo ---------------------------------------------------------------------

def monte_carlo_curves(df: DataFrame, keys: Sequence[str], n_mc: int, seed: int = 0, *, cell: float = 1.0) -> DataFrame:
    """Flux-randomised, resampled curves: ``mc`` numbers the repeats.

    Every repeat draws n of the n points with replacement, keeps each drawn
    point once, and scatters its flux by error / sqrt(times drawn). Draws are
    hashes of (series, repeat, point), so a lost task repeats the same curve and
    no two points share a draw.
    """
    numbered = stored(ordered(df, keys, "t", cell=cell, index="_i", size="_n"), "numbered")
    own = [*keys, "mc", "_i"]
    repeats = F.explode(F.sequence(F.lit(0), F.lit(n_mc - 1))).alias("mc")
    drawn = numbered.select(*[col(k) for k in keys], "_i", "_n", repeats)
    pick = F.floor(uniform(own, f"{seed}/pick") * F.col("_n")) + 1
    counts = drawn.select(*[col(k) for k in keys], "mc", pick.alias("_i")) \
                  .groupBy(*[col(k) for k in keys], "mc", "_i").agg(F.count(F.lit(1)).alias("_times"))
    points = join_null_safe(numbered, counts, [*keys, "_i"])
    noise = gaussian(own, f"{seed}/noise")
    return points.select(*[col(k) for k in keys], "mc", "t",
                         (F.col("flux") + F.col("error") / F.sqrt(F.col("_times").cast("double")) * noise).alias("flux"))


# --- smoothing -----------------------------------------------------------------------

def gaussian_smooth(df: DataFrame, keys: Sequence[str], sigma: float, order: str = "t", value: str = "flux", *,
                    cell: float = 1.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter with ``sigma`` in samples; the series is mirrored at its ends."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    scale = sum(weights)
    weights = [w / scale for w in weights]
    numbered = ordered(df, keys, order, cell=cell, index="_i", size="_n")
    turns = F.ceil(F.lit(radius) / (2 * F.col("_n"))).cast("long")
    period = F.sequence(-turns, turns)
    images = F.concat(F.transform(period, lambda p: F.col("_i") + 2 * p * F.col("_n")),
                      F.transform(period, lambda p: 1 - F.col("_i") + 2 * p * F.col("_n")))
    used = F.filter(images, lambda p: (p >= 1 - radius) & (p <= F.col("_n") + radius))
    padded = numbered.withColumn("_p", F.explode(used))

    def shifted(k: int):
        return F.lag(col(value), -k) if k < 0 else F.lead(col(value), k)

    def build(window):
        return [add(F.lit(w) * (col(value) if k == 0 else shifted(k).over(window))
                    for w, k in zip(weights, range(-radius, radius + 1))).alias("smoothed")]

    out = over_blocks(padded, keys, "_p", build, before=radius, after=radius)
    return out.where(F.col("_p") == F.col("_i")).drop("_i", "_n", "_p")
