"""Series and spectrum operators against direct NumPy computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import series as R
from skyloom.operators import spectra as Q
from skyloom.sources import readers as I


def _curve(seed, n=40, span=30.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    return t, 5 + np.sin(t / 3) + 0.1 * rng.normal(size=n)


def _frame(spark, curves):
    rows = [(k, float(t), float(y), 0.1) for k, (ts, ys) in curves.items() for t, y in zip(ts, ys)]
    return spark.createDataFrame(rows, "s string, t double, flux double, error double").repartition(5)


def _line(x, y, q):
    k = np.clip(np.searchsorted(x, q, side="right") - 1, 0, len(x) - 2)
    return y[k] + (y[k + 1] - y[k]) / (x[k + 1] - x[k]) * (q - x[k])


def test_interpolation_extends_the_end_segments(spark):
    curves = {"a": _curve(1), "b": _curve(2, 15)}
    queries = np.linspace(-3, 35, 77)
    qs = spark.createDataFrame([(s, float(q)) for s in curves for q in queries], "s string, t double")
    got = R.interpolate(_frame(spark, curves), qs, ["s"], cell=2.5).collect()
    assert len(got) == 2 * len(queries)
    for s, (x, y) in curves.items():
        mine = sorted((r.t, r.flux) for r in got if r.s == s)
        assert np.allclose([m[1] for m in mine], _line(x, y, queries))


def test_single_point_series(spark):
    df = _frame(spark, {"one": ([2.0], [7.0])})
    qs = spark.createDataFrame([("one", 9.0)], "s string, t double")
    assert R.interpolate(df, qs, ["s"]).first().flux == 7.0
    assert [r.flux for r in R.resample(df, ["s"], 3).collect()] == [7.0] * 3


@pytest.mark.parametrize("factor", [1, 3])
def test_resampling_has_every_grid_point_once(spark, factor):
    curves = {"a": _curve(3), "b": (np.arange(10.0), np.arange(10.0) ** 2)}
    got = R.resample(_frame(spark, curves), ["s"], factor, cell=4.0).collect()
    for s, (x, y) in curves.items():
        grid = np.linspace(x[0], x[-1], factor * len(x))
        mine = sorted((r.j, r.t, r.flux) for r in got if r.s == s)
        assert [m[0] for m in mine] == list(range(len(grid)))
        assert np.allclose([m[2] for m in mine], np.interp(grid, x, y))


@pytest.mark.parametrize("block", [4096, 7])
def test_synthetic_curve(spark, block):
    t, c = _curve(4, 33)
    psi = np.exp(-t / 4)
    df = spark.createDataFrame([("a", float(a), float(b), float(p)) for a, b, p in zip(t, c, psi)], "s string, t double, flux double, psi double")
    got = sorted((r.t, r.synthetic) for r in R.synthetic_curve(df, ["s"], t_stop=100.0, block=block).collect())
    change = (c - c[0]) / (c.max() - c.min())
    n, p = len(t), psi / psi.max()
    want = np.zeros(n)
    for i in range(n):
        for k in range(i + 1):
            step = t[k + 1] - t[k] if i < n - 1 else t[-1] - t[-2]
            want[i] += p[i - k] * change[k] * step
    want /= want.max() - want.min()
    assert np.allclose([g[1] for g in got], want)


def _crosscor(a, b, lags):
    a, b = a - a.mean(), b - b.mean()
    m, out = len(a), []
    for lag in lags:
        lo, hi = max(0, -lag), min(m, m - lag)
        out.append((a[lo:hi] * b[lo + lag:hi + lag]).sum())
    return np.array(out) / math.sqrt((a * a).sum() * (b * b).sum())


@pytest.mark.parametrize("block, t_range", [(65536, None), (9, None), (16, (1.0, 20.0))])
def test_cross_correlation(spark, block, t_range):
    tu, u = _curve(5, 30)
    tv, v = _curve(6, 26)
    lags = list(range(-6, 9))
    got = R.cross_correlation(_frame(spark, {"a": (tu, u)}), _frame(spark, {"a": (tv, v)}), ["s"], lags=lags, z=0.2,
                              t_range=t_range, factor=2, block=block, cell=3.0).orderBy("lag_index").collect()
    xu, xv = (tu - tu[0]) / 1.2, (tv - tv[0]) / 1.2
    if t_range:
        ku, kv = (xu > t_range[0]) & (xu < t_range[1]), (xv > t_range[0]) & (xv < t_range[1])
        xu, u, xv, v = xu[ku], u[ku], xv[kv], v[kv]
    rs, steps = [], []
    for x in (xu, xv):
        grid = np.linspace(x[0], x[-1], 2 * len(x))
        rs.append(_crosscor(_line(xu, u, grid), _line(xv, v, grid), lags))
        steps.append(grid[1] - grid[0])
    assert [r.lag_index for r in got] == lags
    assert np.allclose([r.r for r in got], np.mean(rs, axis=0), atol=1e-9)
    assert np.allclose([r.lag for r in got], np.array(lags) * np.mean(steps))


def _plain_ccf(tu, u, tv, v, factor, window):
    """Lag and correlation over the lags of a time window, both grids averaged by lag index."""
    sums = {}
    for x in (tu, tv):
        grid = np.linspace(x[0], x[-1], factor * len(x))
        step = grid[1] - grid[0]
        lags = list(range(math.ceil(window[0] / step - 1e-9), math.floor(window[1] / step + 1e-9) + 1))
        for lag, r in zip(lags, _crosscor(_line(tu, u, grid), _line(tv, v, grid), lags)):
            sums.setdefault(lag, []).append((lag * step, r))
    return {lag: np.mean(v, axis=0) for lag, v in sums.items()}


def test_time_window_of_lags_for_every_series(spark):
    tv, v = _curve(6, 26)
    curves = {k: _curve(10 + n, 20 + n) for n, k in enumerate("abc")}
    got = R.cross_correlation(_frame(spark, curves), _frame(spark, {k: (tv, v) for k in curves}), ["s"], lags=(-0.5, 1.0), factor=20, cell=3.0, block=64).collect()
    for k, (t, y) in curves.items():
        want = _plain_ccf(t - t[0], y, tv - tv[0], v, 20, (-0.5, 1.0))
        own = {r.lag_index: (r.lag, r.r) for r in got if r.s == k}
        assert sorted(own) == sorted(want) and all(np.allclose(own[lag], want[lag], atol=1e-9) for lag in want)


def test_centroid_is_null_where_nothing_correlates(spark):
    rows = [("a", k, k / 10, -0.5 - k / 100) for k in range(-3, 4)] + [("b", k, k / 10, 1.0 - abs(k - 1) / 2) for k in range(-3, 4)] + [("c", 0, 0.0, None)]
    ccf = spark.createDataFrame(rows, "s string, lag_index long, lag double, r double")
    got = {r.s: r.delay for r in R.ccf_centroid(ccf, ["s"]).collect()}
    assert got == {"a": None, "b": pytest.approx(0.1), "c": None} and R.ccf_peak(ccf, ["s"]).count() == 3


def test_binned_delays_against_numpy(spark):
    rng = np.random.default_rng(21)
    lam = np.arange(1500.0, 1560.0, 2.0)
    days = np.sort(rng.uniform(0, 20, 25))
    flux = [[5 + math.sin((t - 1 - (w - 1500) / 60) / 2) + 0.05 * rng.normal() for w in lam] for t in days]
    rows = [(f"v{i}", float(t), float(w), float(f), 0.05, float(f)) for i, t in enumerate(days) for w, f in zip(lam, flux[i])]
    spectra = spark.createDataFrame(rows, "visit string, t double, `lambda` double, flux double, error double, model_flux double")
    tc = np.linspace(0, 20, 30)
    continuum = spark.createDataFrame([(float(t), float(math.sin(t / 2))) for t in tc], "t double, flux double")
    edges = [(1500.0, 1506.0), (1552.0, 1558.0)]
    got = {r.bin: r.delay for r in Q.binned_delays(spectra, continuum, 20.0, 1500.0, 1560.0, n_mc=2, seed=5, lags=(-1.0, 4.0), factor=10, cont=edges).collect()}
    lines = Q.line_light_curves(spectra, 20.0, 1500.0, 1560.0, edges, use_model=True).where("flux IS NOT NULL").select("bin", "t", "flux", "error")
    drawn = {}
    for r in R.monte_carlo_curves(lines, ["bin"], 2, 5).collect():
        drawn.setdefault((r["bin"], r["mc"]), []).append((r["t"], r["flux"]))
    delays = {b: [] for b, _ in drawn}
    for (b, _), points in drawn.items():
        t, y = np.array(sorted(points)).T
        ccf = np.array(list(_plain_ccf(tc - tc[0], np.sin(tc / 2), t - t[0], y, 10, (-1.0, 4.0)).values()))
        near = ccf[ccf[:, 1] > 0.8 * ccf[:, 1].max()]
        if ccf[:, 1].max() > 0:
            delays[b].append((near[:, 0] * near[:, 1]).sum() / near[:, 1].sum())
    assert len(got) == 3 and any(delays.values())
    for b, v in delays.items():
        assert got[b] == (pytest.approx(np.mean(v), abs=1e-6) if v else None)


def test_a_curve_correlates_with_itself_at_lag_zero(spark):
    df = _frame(spark, {"a": _curve(7), "b": _curve(8)})
    ccf = R.cross_correlation(df, df, ["s"], factor=2, shared_times=True)
    assert {r.delay for r in R.ccf_peak(ccf, ["s"]).collect()} == {0.0}
    assert all(abs(r.r - 1) < 1e-9 for r in ccf.where("lag_index = 0").collect())
    assert ccf.where("abs(r) > 1.000001").count() == 0


def test_monte_carlo_curves_are_repeatable_resamples(spark):
    df = _frame(spark, {"a": _curve(9, 200)})
    one = R.monte_carlo_curves(df, ["s"], 5, seed=3)
    again = R.monte_carlo_curves(df.repartition(2), ["s"], 5, seed=3)
    rows = sorted(map(tuple, one.collect()))
    assert rows == sorted(map(tuple, again.collect()))
    for mc in range(5):
        n = sum(1 for r in rows if r[1] == mc)
        assert 105 < n < 148  # 1 - 1/e of 200
    merged = one.join(df.withColumnRenamed("flux", "f"), ["s", "t"]).agg(F.stddev(F.col("flux") - F.col("f"))).first()[0]
    assert 0.07 < merged < 0.11


@pytest.mark.parametrize("n", [3, 50])
def test_gaussian_smoothing_mirrors_the_ends(spark, n):
    y = np.random.default_rng(1).normal(size=n)
    df = spark.createDataFrame([("a", float(k), float(v)) for k, v in enumerate(y)], "s string, t double, flux double")
    got = [r.smoothed for r in R.gaussian_smooth(df, ["s"], 1.5, cell=4.0).orderBy("t").collect()]
    radius = int(4 * 1.5 + 0.5)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / 1.5) ** 2)
    padded = np.pad(y, radius, mode="symmetric")
    assert np.allclose(got, np.convolve(padded, w / w.sum(), mode="valid"))


def _spectra(spark, bins=True):
    rng = random.Random(4)
    rows = []
    for visit in range(4):
        for k in range(120):
            if visit == 2 and k % 7 == 0:
                continue  # a visit that misses some wavelengths
            lam = 1500.0 + k
            rows.append((f"v{visit}", float(visit), 1.0, lam, rng.uniform(1, 2), 0.1 + rng.random() / 10, None, rng.uniform(1, 2)))
    return spark.createDataFrame(rows, "visit string, t double, exp double, `lambda` double, flux double, error double, cont_flux double, model_flux double"), rows


def test_line_curves(spark):
    df, rows = _spectra(spark)
    got = {(r.visit, r.bin): (r.flux, r.error) for r in Q.line_light_curves(df, 15.0, 1520.0, 1590.0, cell=5.0).collect()}
    edges = np.linspace(1520, 1590, 6)
    for visit in range(4):
        mine = sorted((r[3], r[7], r[5]) for r in rows if r[1] == visit)
        lam, f, e = (np.array(c) for c in zip(*mine))
        f1, f2 = f[(lam > 1510) & (lam < 1520)].mean(), f[(lam > 1590) & (lam < 1600)].mean()
        m = (f2 - f1) / (1595 - 1515)
        base = f1 + m * (lam - 1515)
        for b in range(5):
            k = (lam > edges[b]) & (lam <= edges[b + 1])
            x, y, err = lam[k], (f - base)[k], e[k]
            area = ((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum()
            noise = math.sqrt((((err[1:] + err[:-1]) * (x[1:] - x[:-1]) / 2) ** 2).sum())
            assert got[f"v{visit}", b + 1] == (pytest.approx(area), pytest.approx(noise))
    early = Q.line_light_curves(df, 15.0, 1520.0, 1590.0, t_stop=1.5).select("visit").distinct().count()
    assert early == 3  # up to and including the first visit at or after the limit


def test_average_spectrum_counts_only_visits_with_the_wavelength(spark):
    df, _ = _spectra(spark)
    rows = {r["lambda"]: r.visits for r in Q.average_spectrum(df, 1505.0, 1515.0).collect()}
    assert rows[1507.0] == 3 and rows[1508.0] == 4 and len(rows) == 9


def test_binned_delays(spark):
    """Every (bin, repeat) equals a direct correlation of the same resampled curve.

    A resample starts its clock at its own first point, so losing the first visit shifts its delay.
    """
    t = np.arange(0, 60.0)
    drive = np.sin(t / 4) + 3
    cont = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, drive)], "t double, flux double")
    rows = [(f"v{int(a)}", float(a), 1.0, 1500.0 + k, 0.0, 1e-6, None, float(1.0 + (np.sin((a - 3) / 4) + 3 if 10 < k <= 30 else 0.0)))
            for a in t for k in range(41)]
    spectra = spark.createDataFrame(rows, "visit string, t double, exp double, `lambda` double, flux double, error double, cont_flux double, model_flux double")
    edges = [(1500.0, 1506.0), (1552.0, 1558.0)]
    got = {r.bin: r.delay for r in Q.binned_delays(spectra, cont, 10.0, 1510.0, 1530.0, n_mc=2, seed=8, factor=1, lags=list(range(-9, 10))).collect()}
    lines = Q.line_light_curves(spectra, 10.0, 1510.0, 1530.0).select("bin", "t", "flux", "error")
    repeats = R.monte_carlo_curves(lines, ["bin"], 2, 8).collect()
    lags = np.arange(-9, 10)
    for b in (1, 2):
        delays = []
        for mc in (0, 1):
            tv, v = np.array(sorted((r.t, r.flux) for r in repeats if r.bin == b and r.mc == mc)).T
            tv = tv - tv[0]
            rs, steps = [], []
            for x in (t, tv):
                grid = np.linspace(x[0], x[-1], len(x))
                rs.append(_crosscor(_line(t, drive, grid), _line(tv, v, grid), lags))
                steps.append(grid[1] - grid[0])
            r, lag = np.mean(rs, axis=0), lags * np.mean(steps)
            near = r > 0.8 * r.max()
            delays.append((r[near] * lag[near]).sum() / r[near].sum())
        assert got[b] == pytest.approx(np.mean(delays), abs=1e-6)


def _profile(spark, values):
    n = len(values)
    rows = [(1, k + 1, float(k - n // 2) + 0.5, float(v), float(k)) for k, v in enumerate(values)]
    return Q.normalise_profiles(spark.createDataFrame(rows, "m int, bin int, v double, flux double, phase double"), ["m"])


@pytest.mark.parametrize("values, tags", [
    ([0, 1, 2, 3, 4, 3, 2, 1, 0, 0], (True, False)),
    ([0, 1, 4, 3, 2, 3.5, 2, 1, 1, 0], (True, False)),    # the rise lies beyond the shorter side of the support
    ([0, 1, 3, 1, 5, 4, 3, 2, 1, 0], (False, True)),
    ([0] * 10, (False, False)),
])
def test_peak_tags(spark, values, tags):
    row = Q.tag_profiles(_profile(spark, values), ["m"], 10).first()
    assert (row.singlePeak, row.doublePeak) == tags


def test_profile_without_flux(spark):
    dark = _profile(spark, [0] * 10)
    assert tuple(Q.tag_rotation(dark, ["m"]).first())[1:] == ("none", 0.0)
    assert Q.fwhm(dark, ["m"]).first().FHWM == -1.0
    lit = _profile(spark, [0, 1, 2, 3, 4, 3, 2, 1, 0, 0])
    assert tuple(Q.tag_rotation(lit, ["m"]).first())[1:] == ("cw", 9.0)
    assert Q.fwhm(lit, ["m"]).first().FHWM == 2.0


def test_line_skipping_counts_per_file(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}-{i}\n" for i in range(50)))
    got = sorted(r.value for r in I.read_lines(spark, str(tmp_path), 30).collect())
    assert got == sorted(f"{k}-{i}" for k in range(3) for i in range(30, 50))
