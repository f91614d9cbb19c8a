"""Light curves, spectra and line profiles derived from ``events``."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import aggregates as A
from ..operators import binning as B
from ..operators import series as R
from ..operators import spectra as Q
from ..operators.ordering import ordered
from ..session import stored
from .bindings import (
    CURVES_SQL, RAYS_SQL, SPECTRA_SQL, curves, gaussian_sql, rays, spectra, table, uniform_sql, with_sql,
)
from .registry import query, rounded

K = {"k": CURVES_SQL}
CELL = 1.0


def _wide(spark, d):
    orders = table(spark, d, "orders")
    return orders.select((F.col("o_orderkey").cast("double") / 100 + 7).alias("t"), *[c for k, n in enumerate(S.CURVE_NAMES) for c in (
        (F.col("o_totalprice") * (k + 1)).alias(S.flux_column(n)),
        (F.col("o_custkey").cast("double") / (k + 1)).alias("e_" + S.flux_column(n)))])


@query("ts1_light_curve", """SELECT round(t - t0, 9) AS t, flux, round(error, 9) AS error FROM (SELECT CAST(o_orderkey AS DOUBLE) / 100 + 7 AS t,
    o_totalprice * 8 AS flux, CAST(o_custkey AS DOUBLE) / 8 AS error, min(CAST(o_orderkey AS DOUBLE) / 100 + 7) OVER () AS t0 FROM orders) WHERE t - t0 < 75""")
def _(spark, d):
    return rounded(R.light_curve(_wide(spark, d), "CIV"), 9, ["t", "error"])


@query("ts2_normalise_curve", with_sql(K, """SELECT series_id, round(t, 9) AS t, round((flux / hi - f0 / hi) / ((hi - lo) / hi), 9) AS flux FROM
    (SELECT *, max(flux) OVER p AS hi, min(flux) OVER p AS lo, first_value(flux) OVER (PARTITION BY series_id ORDER BY t) AS f0 FROM k
    WINDOW p AS (PARTITION BY series_id))"""))
def _(spark, d):
    out = R.normalise_curve(curves(spark, d), ["series_id"])
    return rounded(out.select("series_id", "t", "flux"), 9)


_SEG = """SELECT series_id, t AS x0, flux AS y0, lead(t) OVER w AS x1, coalesce((lead(flux) OVER w - flux) / (lead(t) OVER w - t), 0) AS s,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM {src} WINDOW w AS (PARTITION BY series_id ORDER BY t)"""


@query("ts3_jn8_interpolate", with_sql({**K, "seg": "SELECT * FROM (" + _SEG.format(src="k") + ") WHERE x1 IS NOT NULL OR n = 1",
       "q": "SELECT series_id, t - 0.3 / 24 + (CASE WHEN h % 2 = 0 THEN 0.1 ELSE -0.2 END) AS x FROM (SELECT series_id, t, CAST(round(t * 24) AS BIGINT) AS h FROM k)"},
       """SELECT series_id, round(x, 9) AS t, round(arg_max(y0 + s * (x - x0), x0), 5) AS flux FROM (
       SELECT q.series_id, x, x0, y0, s FROM q JOIN seg USING (series_id) WHERE x0 <= x OR i = 1) GROUP BY ALL"""))
def _(spark, d):
    k = curves(spark, d)
    hour = F.round(F.col("t") * 24).cast("long")
    queries = k.select("series_id", (F.col("t") - 0.3 / 24 + F.when(hour % 2 == 0, 0.1).otherwise(-0.2)).alias("t"))
    return rounded(rounded(R.interpolate(k, queries, ["series_id"], cell=CELL), 9, ["t"]), 5, ["flux"])


_GRID2 = """SELECT series_id, min(t) AS g0, count(*) * {f} AS m, (max(t) - min(t)) / (count(*) * {f} - 1) AS step FROM {src} GROUP BY 1"""


@query("ts4_resample", with_sql({**K, "seg": _SEG.format(src="k"), "g": _GRID2.format(src="k", f=100),
       "p": "SELECT series_id, j, g0 + j * step AS x FROM (SELECT *, unnest(range(m)) AS j FROM g)"},
       """SELECT p.series_id, CAST(j AS BIGINT) AS j, round(x, 7) AS t, round(y0 + s * (x - x0), 4) AS flux FROM p ASOF JOIN (SELECT * FROM seg WHERE x1 IS NOT NULL) seg
       ON p.series_id = seg.series_id AND p.x + 1e-12 >= seg.x0"""))
def _(spark, d):
    out = R.resample(curves(spark, d), ["series_id"], cell=CELL)
    return rounded(rounded(out, 7, ["t"]), 4, ["flux"])


_PSI = "exp(-(t - 3) * (t - 3) / 2)"


@query("ts5_jn7_synthetic_curve", with_sql({**K, "x": f"SELECT *, {_PSI} AS psi FROM k",
       "n": """SELECT series_id, t, row_number() OVER w AS i, count(*) OVER p AS n, (flux - first_value(flux) OVER w) / (max(flux) OVER p - min(flux) OVER p) AS change,
       coalesce(lead(t) OVER w - t, t - lag(t) OVER w) AS step, psi / max(psi) OVER p AS psi FROM x WINDOW w AS (PARTITION BY series_id ORDER BY t), p AS (PARTITION BY series_id)""",
       "y": """SELECT a.series_id, a.t, a.change, sum(b.change * c.psi * CASE WHEN a.i = a.n THEN a.step ELSE b.step END) AS y FROM n a JOIN n b ON a.series_id = b.series_id
       AND b.i <= a.i JOIN n c ON a.series_id = c.series_id AND c.i = a.i - b.i + 1 GROUP BY 1, 2, 3"""},
       """SELECT series_id, round(t, 9) AS t, round(change, 6) AS change, round(y / (max(y) OVER p - min(y) OVER p), 6) AS synthetic FROM y
       WINDOW p AS (PARTITION BY series_id)"""))
def _(spark, d):
    k = curves(spark, d).withColumn("psi", F.exp(-(F.col("t") - 3) * (F.col("t") - 3) / 2))
    out = R.synthetic_curve(k, ["series_id"], cell=CELL)
    return rounded(rounded(out, 9, ["t"]), 6, ["change", "synthetic"])


def _against_continuum(spark, d):
    """Every other series and, under its key, the continuum (``view``)."""
    k = curves(spark, d).select("series_id", "t", "flux")
    u = k.where("series_id <> 'view'")
    v = k.where("series_id = 'view'").drop("series_id").join(u.select("series_id").distinct())
    return u, v


def _dot_sql(g: str, keys: list[str], lags: str) -> dict[str, str]:
    """Correlation per lag of the centred columns a and b of ``c{g}``: one product of two slices a lag."""
    by = ", ".join(keys)
    return {f"e{g}": f"SELECT {by}, any_value(step) AS step, count(*) AS m, sqrt(sum(a * a) * sum(b * b)) AS e, list(a ORDER BY j) AS la, list(b ORDER BY j) AS lb FROM c{g} GROUP BY {by}",
            f"l{g}": f"SELECT *, unnest({lags}) AS l FROM e{g}",
            f"r{g}": f"""SELECT {by}, l, l * step AS lag, CASE WHEN abs(l) < m THEN list_dot_product(la[greatest(0, -l) + 1:least(m, m - l)],
                lb[greatest(0, l) + 1:least(m, m + l)]) ELSE 0 END / nullif(e, 0) AS r FROM l{g}"""}


def _ccf_ctes(lags: str) -> dict[str, str]:
    out = dict(K)
    out["u"] = "SELECT series_id, (t - min(t) OVER (PARTITION BY series_id)) / 1.5 AS t, flux FROM k WHERE series_id <> 'view'"
    out["v"] = """SELECT s.series_id, (t - min(t) OVER (PARTITION BY s.series_id)) / 1.5 AS t, flux FROM (SELECT t, flux FROM k WHERE series_id = 'view')
        CROSS JOIN (SELECT DISTINCT series_id FROM u) s"""
    for side in ("u", "v"):
        out[f"s{side}"] = "SELECT * FROM (" + _SEG.format(src=side) + ") WHERE x1 IS NOT NULL"
    for g in ("u", "v"):
        out[f"g{g}"] = _GRID2.format(src=g, f=100)
        out[f"p{g}"] = f"SELECT series_id, j, step, m, g0 + j * step AS x FROM (SELECT *, unnest(range(m)) AS j FROM g{g})"
        for side in ("u", "v"):
            out[f"f{g}{side}"] = (f"SELECT p.series_id, p.j, p.step, p.m, y0 + s * (x - x0) AS y FROM (SELECT *, x + 1e-12 AS near FROM p{g}) p ASOF JOIN s{side} q "
                                  f"ON p.series_id = q.series_id AND near >= x0")
        out[f"c{g}"] = (f"SELECT a.series_id, a.j, a.step, a.y - avg(a.y) OVER w AS a, b.y - avg(b.y) OVER w AS b FROM f{g}u a JOIN f{g}v b USING (series_id, j) "
                        f"WINDOW w AS (PARTITION BY a.series_id)")
        out |= _dot_sql(g, ["series_id"], lags)
    out["ccf"] = "SELECT series_id, CAST(l AS BIGINT) AS lag_index, avg(lag) AS lag, avg(r) AS r FROM (SELECT * FROM ru UNION ALL SELECT * FROM rv) GROUP BY 1, 2"
    return out


_REACH = "CAST(least(m - 1, floor(10 * log10(m))) AS BIGINT)"
_AUTO = f"range(-{_REACH}, {_REACH} + 1)"
_CCF = "SELECT series_id, lag_index, round(lag, 8) AS lag, round(r, 6) AS r FROM ccf"


@query("ts6_cross_correlation", with_sql(_ccf_ctes(_AUTO), _CCF))
def _(spark, d):
    out = R.cross_correlation(*_against_continuum(spark, d), ["series_id"], z=0.5, cell=CELL)
    return rounded(rounded(out, 8, ["lag"]), 6, ["r"])


@query("ts6_time_window_lags")
def _(spark, d):
    """No SQL: equal on scale factor 0.01, but DuckDB takes 95 s there; tests/test_series.py has numpy."""
    out = R.cross_correlation(*_against_continuum(spark, d), ["series_id"], z=0.5, lags=(-0.5, 1.0), cell=CELL)
    return rounded(rounded(out, 8, ["lag"]), 6, ["r"])


@query("ts7_peak_and_centroid", with_sql({**_ccf_ctes(_AUTO), "top": "SELECT *, max(r) OVER (PARTITION BY series_id) AS best FROM ccf"},
       """SELECT series_id, round(arg_max(lag, (r, -lag_index)), 6) AS peak, round(sum(CASE WHEN best > 0 AND r > 0.8 * best THEN r * lag END)
       / sum(CASE WHEN best > 0 AND r > 0.8 * best THEN r END), 6) AS centroid FROM top GROUP BY 1"""))
def _(spark, d):
    ccf = stored(R.cross_correlation(*_against_continuum(spark, d), ["series_id"], z=0.5, cell=CELL), "ccf")
    peak = R.ccf_peak(ccf, ["series_id"]).withColumnRenamed("delay", "peak")
    return rounded(peak.join(R.ccf_centroid(ccf, ["series_id"]).withColumnRenamed("delay", "centroid"), "series_id"))


def _mc_sql(source: str, n_mc: int, seed: int, keys: str) -> dict[str, str]:
    return {
        "numbered": f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}",
        "draws": f"SELECT {keys}, mc, CAST(floor({uniform_sql(f'{keys}, mc, i', f'{seed}/pick')} * n) AS BIGINT) + 1 AS pick, count(*) AS times FROM "
                 f"(SELECT *, unnest(range({n_mc})) AS mc FROM numbered) GROUP BY ALL",
        "mcurve": f"SELECT a.{keys}, CAST(mc AS INT) AS mc, a.t, flux + error / sqrt(times::DOUBLE) * {gaussian_sql(f'a.{keys}, mc, a.i', f'{seed}/noise')} AS flux "
                  f"FROM numbered a JOIN draws d ON a.{keys} = d.{keys} AND a.i = d.pick",
    }


@query("ts8_monte_carlo_curves", with_sql({**K, **_mc_sql("k", 3, 31, "series_id")},
       "SELECT series_id, mc, round(t, 9) AS t, round(flux, 6) AS flux FROM mcurve"))
def _(spark, d):
    k = curves(spark, d)
    out = R.monte_carlo_curves(k, ["series_id"], 3, 31, cell=CELL)
    return rounded(rounded(out, 9, ["t"]), 6, ["flux"])


def _smooth_sql(sigma: float) -> str:
    radius = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1))
    return with_sql({**K, "n": "SELECT series_id, t, flux, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t)",
                     "o": f"SELECT n.series_id, n.t, n.i, n.n, o, n.i + o AS p, exp(-0.5 * (o / {sigma}::DOUBLE) * (o / {sigma}::DOUBLE)) / {total!r}::DOUBLE AS w FROM n, (SELECT unnest(range(-{radius}, {radius + 1})) AS o)",
                     "f": "SELECT *, ((p - 1) % (2 * n) + 2 * n) % (2 * n) AS q FROM o",
                     "z": "SELECT *, CASE WHEN q < n THEN q + 1 ELSE 2 * n - q END AS src FROM f"},
                    """SELECT z.series_id, round(z.t, 9) AS t, round(sum(w * k.flux), 6) AS smoothed FROM z JOIN n k ON k.series_id = z.series_id AND k.i = z.src GROUP BY 1, 2""")


@query("ts10_gaussian_smooth", _smooth_sql(2.0))
def _(spark, d):
    out = R.gaussian_smooth(curves(spark, d), ["series_id"], 2.0, cell=CELL)
    return rounded(rounded(out.select("series_id", "t", "smoothed"), 9, ["t"]), 6, ["smoothed"])


@query("ts11_match_scale", with_sql(K, """SELECT series_id, round(t, 9) AS t, round(t / 30 * (max(flux) OVER p - min(flux) OVER p) + first_value(flux) OVER w, 6) AS synthetic
    FROM k WINDOW p AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY t)"""))
def _(spark, d):
    k = curves(spark, d)
    model = k.select("series_id", "t", (F.col("t") / 30).alias("synthetic"))
    return rounded(rounded(R.match_scale(model, k, ["series_id"]), 9, ["t"]), 6, ["synthetic"])


@query("srt3_time_order", with_sql({**K, **_mc_sql("k", 2, 31, "series_id")},
       "SELECT series_id, mc, round(t, 9) AS t, row_number() OVER (PARTITION BY series_id, mc ORDER BY t) AS rank FROM mcurve"))
def _(spark, d):
    k = curves(spark, d)
    draws = R.monte_carlo_curves(k, ["series_id"], 2, 31, cell=CELL)
    return rounded(ordered(draws, ["series_id", "mc"], "t", cell=CELL, index="rank").select("series_id", "mc", "t", "rank"), 9)


# --- spectra ---------------------------------------------------------------------------

SP = {"sp": SPECTRA_SQL}


@query("spc2_jn5_set2_average_spectrum", with_sql(SP, """SELECT "lambda", round(avg(flux), 6) AS flux, round(sqrt(sum(error * error)) / count(*), 6) AS error,
    round(avg(model_flux), 6) AS model_flux, count(*) AS visits FROM sp WHERE "lambda" > 1460 AND "lambda" < 1725 GROUP BY 1"""))
def _(spark, d):
    return rounded(Q.average_spectrum(spectra(spark, d), 1460.0, 1725.0))


def _line_sql(dl: float, lo: float, hi: float, cont, flux: str) -> dict[str, str]:
    bins = math.ceil((hi - lo) / dl)
    width = (hi - lo) / bins
    (a0, a1), (b0, b1) = cont
    l1, l2 = (a0 + a1) / 2, (b0 + b1) / 2
    return {
        **SP,
        "rw": f"SELECT visit, t - (SELECT min(t) FROM sp) AS t, \"lambda\" AS wl, {flux} AS f, error FROM sp",
        "side": f"SELECT visit, t, avg(CASE WHEN wl > {a0} AND wl < {a1} THEN f END) AS f1, avg(CASE WHEN wl > {b0} AND wl < {b1} THEN f END) AS f2 FROM rw GROUP BY 1, 2",
        "line": f"SELECT visit, t, (f2 - f1) / {l2 - l1}::DOUBLE AS m, f1 AS b FROM side",
        "bn": f"SELECT *, CAST(ceil((wl - {lo}::DOUBLE) / {width!r}::DOUBLE) AS INT) AS bin FROM rw WHERE wl > {lo} AND wl <= {hi}",
        "pr": "SELECT visit, bin, wl, f, error, lag(wl) OVER w AS pl, lag(f) OVER w AS pf, lag(error) OVER w AS pe FROM bn WINDOW w AS (PARTITION BY visit, bin ORDER BY wl)",
        "ar": f"""SELECT visit, bin, sum((wl - pl) * ((pf - (m * (pl - {l1}) + b)) + (f - (m * (wl - {l1}) + b))) / 2) AS a, sum(power((error + pe) * (wl - pl) / 2, 2)) AS e2
            FROM pr JOIN line USING (visit) WHERE pl IS NOT NULL GROUP BY 1, 2""",
        "cells": f"SELECT visit, t, bin, {lo}::DOUBLE + (bin - 0.5) * {width!r}::DOUBLE AS centre, CASE WHEN e2 IS NULL THEN 0 ELSE a END AS flux, sqrt(coalesce(e2, 0)) AS error FROM (SELECT visit, t, CAST(unnest(range(1, {bins + 1})) AS INT) AS bin FROM line) LEFT JOIN ar USING (visit, bin)",
    }


_CONT = [(1500.0, 1540.0), (1680.0, 1720.0)]


@query("spc3_line_light_curves", with_sql(_line_sql(25.0, 1540.0, 1680.0, _CONT, "model_flux"),
       "SELECT visit, t, bin, round(centre, 6) AS centre, round(flux, 6) AS flux, round(error, 6) AS error FROM cells"))
def _(spark, d):
    out = Q.line_light_curves(spectra(spark, d), 25.0, 1540.0, 1680.0, _CONT)
    return rounded(out, 6, ["centre", "flux", "error"])


def _delays(spark, d, n_mc=2):
    continuum = curves(spark, d).where("series_id = 'purchase'")
    return Q.binned_delays(spectra(spark, d), continuum, 35.0, 1540.0, 1680.0, n_mc=n_mc, seed=41, cont=_CONT, lags=(-3.0, 6.0))


@query("ts9_binned_delays")
def _(spark, d):
    """No SQL: equal on scale factor 0.01, but DuckDB takes eleven minutes there; tests/test_series.py has numpy."""
    return rounded(_delays(spark, d), 5, ["delay"])


@query("agg9_mean_over_draws", with_sql({**K, **_mc_sql("k", 4, 31, "series_id")},
       "SELECT series_id, round(avg(m), 6) AS mean FROM (SELECT series_id, mc, avg(flux) AS m FROM mcurve GROUP BY 1, 2) GROUP BY 1"))
def _(spark, d):
    k = curves(spark, d)
    draws = R.monte_carlo_curves(k, ["series_id"], 4, 31, cell=CELL)
    per_draw = A.mean_over(draws, "flux", ["series_id", "mc"], "m")
    return rounded(A.mean_over(per_draw, "m", ["series_id"]))


# --- profiles ---------------------------------------------------------------------------

BINS = 100
_STEP = f"(CAST(1 AS DOUBLE) / {BINS})"
PROFILES = {
    "r": RAYS_SQL,
    "b": f"SELECT model_id, greatest(1, CAST(ceil(x / {_STEP}) AS INT)) AS bin, sum(intensity) AS f, sum(phase_weight) AS p FROM r WHERE x >= 0 AND x <= 1 GROUP BY 1, 2",
    "filled": f"SELECT model_id, bin, (0.95 + 0.1 * ((bin - 0.5) * {_STEP}) - 1) * 300000 AS v, coalesce(f, 0) AS f, coalesce(p, 0) / CASE WHEN coalesce(f, 0) = 0 THEN 1 ELSE f END AS phase "
            f"FROM (SELECT DISTINCT model_id FROM r) CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(1, {BINS + 1})) LEFT JOIN b USING (model_id, bin)",
    "prof": "SELECT model_id, bin, v, phase, f / max(f) OVER (PARTITION BY model_id) AS lp FROM filled",
}


def profiles(spark, d):
    sums = B.histogram_sums(rays(spark, d), "x", {"flux": "intensity", "_p": "phase_weight"}, 0.0, 1.0, BINS, ["model_id"])
    both = sums.withColumns({"phase": B.safe_ratio("_p", "flux"), "v": (0.95 + 0.1 * F.col("centre") - 1) * 300000})
    return Q.normalise_profiles(both, ["model_id"]).select("model_id", "bin", "v", "phase", "lp")


@query("spc4_tag_profiles", with_sql({**PROFILES,
       "pk": "SELECT model_id, arg_max(bin, (lp, -bin)) AS peak, min(CASE WHEN lp > 0 THEN bin END) AS lo, max(CASE WHEN lp > 0 THEN bin END) AS hi FROM prof GROUP BY 1",
       "ri": """SELECT p.model_id, abs(p.bin - peak) AS dist, least(peak - lo, hi - peak) AS reach, q.lp > p.lp AS rise FROM prof p JOIN pk USING (model_id)
       JOIN prof q ON q.model_id = p.model_id AND ((p.bin <= peak AND q.bin = p.bin - 1) OR (p.bin >= peak AND q.bin = p.bin + 1))"""},
       """SELECT model_id, NOT dbl AS "singlePeak", dbl AS "doublePeak" FROM (SELECT model_id, coalesce(bool_or(rise AND dist >= 1 AND dist < reach - 1), false) AS dbl FROM pk LEFT JOIN ri USING (model_id) GROUP BY 1)"""))
def _(spark, d):
    return Q.tag_profiles(profiles(spark, d), ["model_id"], BINS)


@query("spc5_tag_rotation", with_sql(PROFILES, """SELECT model_id, CASE WHEN avg(CASE WHEN v < 0 THEN phase END) > avg(CASE WHEN v > 0 THEN phase END) THEN 'ccw' ELSE 'cw' END AS rotation,
    round(max(phase) - min(phase), 6) AS "phaseAmplitude" FROM prof GROUP BY 1"""))
def _(spark, d):
    return rounded(Q.tag_rotation(profiles(spark, d), ["model_id"]))


@query("spc6_fwhm", with_sql(PROFILES, """SELECT model_id, round(arg_max(v, bin) FILTER (lp > 0.5) - arg_min(v, bin) FILTER (lp > 0.5), 6) AS "FHWM" FROM prof GROUP BY 1"""))
def _(spark, d):
    return rounded(Q.fwhm(profiles(spark, d), ["model_id"]))


@query("spc7_rescale_phase", with_sql(PROFILES, "SELECT model_id, bin, round(phase * lp / (1 + lp), 6) AS phase FROM prof"))
def _(spark, d):
    return rounded(Q.rescale_phase(profiles(spark, d)).select("model_id", "bin", "phase"))


# --- headers ---------------------------------------------------------------------------

_KINDS = ["Broad CIV", "Broad Absorption CIV", "Narrow CIV", "CIV Bump", "Broad NV"]
_HEADER = ("concat('SIMPLE EXPTIME = ', page_id % 700, '.5 / s HJDSTART=  ', 56690 + page_id, '.25 HISTORY Gaussian component ', page_id % 40, ': ', "
           "CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_KINDS)) + " END, ' HISTORY fitted from ', url)")


@query("spc1_line_components", """SELECT page_id, CAST(page_id % 40 AS INT) AS component FROM pages WHERE page_id % 5 IN (0, 3)""")
def _(spark, d):
    headers = table(spark, d, "pages").select("page_id", F.expr(_HEADER).alias("header"))
    return Q.line_components(headers, "header", "CIV").select("page_id", "component")


@query("spc8_header_values", "SELECT page_id, page_id % 700 + 0.5::DOUBLE AS exp, 56690 + page_id + 0.25::DOUBLE AS t FROM pages")
def _(spark, d):
    headers = table(spark, d, "pages").select("page_id", F.expr(_HEADER).alias("header"))
    return Q.header_values(headers, "header").select("page_id", "exp", "t")
