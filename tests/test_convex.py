"""Linear machines against direct solvers, and their certificates against plain numpy."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyloom.operators import blocks as B
from skyloom.operators import convex
from skyloom.operators import learning as M
from skyloom.operators.blocks import pack

COLS = ["a", "b"]


def rows(n, seed, classes="pqr"):
    """Classes that overlap."""
    rng = random.Random(seed)
    centre = {c: (rng.gauss(0, 1.5), rng.gauss(0, 1.5)) for c in classes}
    return [(centre[c][0] + rng.gauss(0, 1), centre[c][1] + rng.gauss(0, 1), c) for c in (rng.choice(classes) for _ in range(n))]


def frame(spark, data, parts=3):
    return spark.createDataFrame([(a, b, 2 * a - b + (5 if k % 9 == 0 else 0), c) for k, (a, b, c) in enumerate(data)],
                                 "a double, b double, y double, class string").repartition(parts)


def scaled(data):
    x = np.array([r[:2] for r in data])
    return (x - x.mean(0)) / x.std(0)


def smo(kernel, y, C, sweeps=20000):
    """Dual of the two-class machine with a free intercept: the most violating pair until none is left."""
    alpha = np.zeros(len(y))
    slope = -np.ones(len(y))
    for _ in range(sweeps):
        up = ((y > 0) & (alpha < C)) | ((y < 0) & (alpha > 0))
        low = ((y < 0) & (alpha < C)) | ((y > 0) & (alpha > 0))
        score = -y * slope
        i, j = np.where(up, score, -np.inf).argmax(), np.where(low, score, np.inf).argmin()
        if score[i] - score[j] < 1e-9:
            break
        step = (score[i] - score[j]) / max(kernel[i, i] + kernel[j, j] - 2 * kernel[i, j], 1e-12)
        step = min(step, C - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else C - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        slope += step * y * (kernel[:, i] - kernel[:, j])
    return alpha, float(alpha.sum() - 0.5 * (alpha * y) @ kernel @ (alpha * y))


@pytest.mark.parametrize("kernel", ["linear", "poly"])
def test_pairs_reach_the_minimum_of_a_direct_solver(spark, kernel):
    data = rows(240, 1)
    model, scored = M.svm(frame(spark, data), frame(spark, data), COLS, "class", kernel, C=0.7, gap=1e-4)
    x, y = scaled(data), np.array([r[2] for r in data])
    gram = x @ x.T if kernel == "linear" else (x @ x.T / 2) ** 3
    assert model.labels == ["p", "q", "r"] and model.pairs == [(0, 1), (0, 2), (1, 2)]
    for (a, b), fit in zip(model.pairs, model.fits):
        own = (y == model.labels[a]) | (y == model.labels[b])
        _, best = smo(gram[np.ix_(own, own)], np.where(y[own] == model.labels[b], 1.0, -1.0), 0.7)
        assert 0 <= fit.gap <= 1e-4 and fit.dual <= best + 1e-6 * best and fit.primal >= best - 1e-6 * best
        assert fit.primal == pytest.approx(best, rel=2e-4)
    phi = model.features(x)
    votes = np.zeros((len(x), 3), int)
    for (a, b), fit in zip(model.pairs, model.fits):
        side = phi @ fit.theta > 0
        votes[side, b] += 1
        votes[~side, a] += 1
    want = sorted((r[0], r[1], "pqr"[v]) for r, v in zip(data, votes.argmax(1)))
    got = sorted((r["a"], r["b"], r["prediction"]) for r in scored.collect())
    assert sum(g == w for g, w in zip(got, want)) >= len(want) - 1  # a row may lie on a border


def test_polynomial_features_have_the_kernel():
    x = np.random.default_rng(1).normal(size=(20, 4))
    features, q = convex.feature_map("poly", 4)
    phi = features(x)
    assert phi.shape == (20, q) and np.allclose(phi[:, :-1] @ phi[:, :-1].T, (x @ x.T / 4) ** 3)


def test_fourier_features_come_near_the_kernel():
    x = np.random.default_rng(2).normal(size=(60, 5))
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 5)
    for size, most in ((128, 0.15), (2048, 0.04)):
        phi = convex.feature_map("rbf", 5, size=size, seed=3)[0](x)[:, :-1]
        assert np.sqrt(((phi @ phi.T - exact) ** 2).mean()) < most


def test_regression_reaches_the_minimum_of_a_direct_solver(spark):
    data = rows(200, 3)
    for epsilon in (0.0, 0.4):
        model, scored = M.linear_svr(frame(spark, data), frame(spark, data), COLS, "y", C=0.5, epsilon=epsilon, gap=1e-5)
        x = np.column_stack([scaled(data), np.ones(len(data))])
        y = np.array([2 * a - b + (5 if k % 9 == 0 else 0) for k, (a, b, _) in enumerate(data)])
        beta, w = np.zeros(len(y)), np.zeros(3)
        for _ in range(3000):  # coordinate ascent on the dual, which has a box alone
            for i in range(len(y)):
                h, g = x[i] @ x[i], y[i] - x[i] @ w + (x[i] @ x[i]) * beta[i]
                new = np.clip(np.sign(g) * max(abs(g) - epsilon, 0.0) / h, -0.5, 0.5)
                w, beta[i] = w + (new - beta[i]) * x[i], new
            dual = beta @ y - epsilon * np.abs(beta).sum() - 0.5 * w @ w
            primal = 0.5 * w @ w + 0.5 * np.maximum(np.abs(y - x @ w) - epsilon, 0).sum()
            if primal - dual < 1e-7 * primal:
                break
        fit = model.fits[0]
        assert 0 <= fit.gap <= 1e-5 and fit.primal == pytest.approx(dual, rel=2e-5) and fit.dual <= primal
        got = sorted((r["a"], r["prediction"]) for r in scored.collect())
        assert [g for _, g in got] == pytest.approx([v for _, v in sorted(zip([r[0] for r in data], x @ fit.theta))])


def test_logistic_gradient_is_zero_on_overlapping_classes(spark):
    data = rows(300, 4)
    fits = [M.logistic(frame(spark, data, parts), frame(spark, data), COLS, "class", C=2.0) for parts in (1, 5)]
    assert (fits[0][0].fits[0].theta == fits[1][0].fits[0].theta).all()
    model, scored = fits[0]
    theta = model.fits[0].theta.reshape(3, 3)
    x, y = np.column_stack([scaled(data), np.ones(300)]), np.array(["pqr".index(r[2]) for r in data])
    z = x @ theta.T
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    slope = 2.0 * (p - np.eye(3)[y]).T @ x + theta * [1, 1, 0]
    assert np.abs(slope).max() < 1e-8 and model.fits[0].passes < 25
    got = scored.agg(*[F.sum(F.col("probabilities")[k]) for k in range(3)]).first()
    assert list(got) == pytest.approx([(y == k).sum() for k in range(3)], abs=1e-6)


def test_edges(spark):
    data = frame(spark, rows(60, 5)).union(spark.createDataFrame([(None, 1.0, 1.0, "p"), (1.0, 1.0, None, None)], "a double, b double, y double, class string"))
    for fit in (lambda *a: M.logistic(*a, COLS, "class"), lambda *a: M.svm(*a, COLS, "class", "linear")):
        model, scored = fit(data, data)
        assert scored.count() == 62 and scored.filter("a IS NULL").first()["prediction"] is None and model.rows == 60
        assert scored.filter("class IS NULL").first()["prediction"] in "pqr"
        empty = fit(data.limit(0), data)[1]
        assert empty.filter("prediction IS NOT NULL").count() == 0
    one = M.svm(data.filter("class = 'p'"), data, COLS, "class", "linear")[1]
    assert {r["prediction"] for r in one.filter("a IS NOT NULL").collect()} == {"p"}
    assert M.linear_svr(data.limit(0), data, COLS, "y")[1].count() == 62


def test_classes_without_structure_take_few_passes(spark):
    rng = random.Random(8)
    data = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.choice("pppqqqqrrr")) for _ in range(2000)]
    for kernel in ("linear", "poly"):
        model, _ = M.svm(frame(spark, data), frame(spark, data), COLS, "class", kernel)
        assert all(0 <= f.gap <= 1e-3 for f in model.fits)
        assert max(f.passes for f in model.fits) <= 60, [f.passes for f in model.fits]


def test_blocks_cross_to_python_in_short_batches(spark):
    wide = spark.range(60000).select(*[F.xxhash64(F.lit(k), "id").cast("double").alias(f"x{k}") for k in range(16)])
    packed = pack(wide, {f"x{k}": F.col(f"x{k}") for k in range(16)})

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    seen = [r[0] for r in packed.frame.coalesce(1).mapInArrow(sizes, "bytes long").collect()]
    assert sum(seen) > 60000 * 17 * 8 and max(seen) < 5 << 20


def test_costs_share_passes_and_equal_single_fits(spark, monkeypatch):
    data, packed = frame(spark, rows(300, 6)), []
    monkeypatch.setattr(M, "pack", lambda *a, **k: packed.append(1) or pack(*a, **k))
    models, scored = M.svm_costs(data, data, COLS, "class", [0.1, 1.0, 5.0], "linear")
    assert len(packed) == 1 and len(models) == 3
    answers = {(r["a"], r["b"]): r["predictions"] for r in scored.collect()}
    for k, C in enumerate((0.1, 1.0, 5.0)):
        model, alone = M.svm(data, data, COLS, "class", "linear", C=C)
        assert all(np.array_equal(x.theta, y.theta) and x.passes == y.passes for x, y in zip(models[k].fits, model.fits))
        assert all(answers[r["a"], r["b"]][k] == r["prediction"] for r in alone.collect())
    together = M.sweep(lambda d, points: [p["C"] + d for p in points], [{"C": 1.0}, {"C": 2.0}], {"x": 0.5, "y": 1.5}, "file string, C double, score double", together=True)
    assert sorted(map(tuple, together.collect())) == [("x", 1.0, 1.5), ("x", 2.0, 2.5), ("y", 1.0, 2.5), ("y", 2.0, 3.5)]


def test_curvatures_of_a_share_of_the_blocks_reach_the_same_minimum(spark, monkeypatch):
    """A block without a drawn curvature returns no Hessian; sums and certificates are of all rows."""
    rng = random.Random(9)
    data = [(rng.gauss(0, 1) + (c == "q"), rng.gauss(0, 1), c) for c in (rng.choice("pq") for _ in range(3000))]
    sizes, exact = [], M.svm(frame(spark, data), frame(spark, data), COLS, "class", "poly", gap=1e-4)[0].fits[0]
    monkeypatch.setattr(convex, "BENT_ROWS", 40)
    kept = convex.Hinge.sums

    def watched(self, phi, y, times, theta, mu, curved=True):
        sizes.append(curved)
        return kept(self, phi, y, times, theta, mu, curved)

    blocks = pack(frame(spark, data).select("a", "b", (F.col("class") == "q").cast("double").alias("y")), {c: F.col(c) for c in ("a", "b", "y")}, block_rows=32)
    monkeypatch.setattr(convex.Hinge, "sums", watched)
    monkeypatch.setattr(convex, "total", lambda blocks, fn, size: sum((np.r_[got, np.zeros(size - len(got))] for r in held for got in [fn(np.frombuffer(r["data"], "<f8").reshape(-1, 4), r["block"])])))
    held, x = blocks.frame.collect(), scaled(data)
    raw = np.array([r[:2] for r in data])
    features, q = convex.feature_map("poly", 2)
    fit, = convex.minimise(blocks, lambda m: features((m - raw.mean(0)) / raw.std(0)), [convex.Hinge(0, 1)], np.r_[np.ones(q - 1), 0.0], 1.0, gap=1e-4)
    assert 0 < sum(sizes) < 0.7 * len(sizes)
    assert 0 <= fit.gap <= 1e-4 and fit.primal == pytest.approx(exact.primal, rel=2e-4)
    over = 1 - np.where([r[2] == "q" for r in data], 1, -1) * (features(x) @ fit.theta)
    assert fit.primal == pytest.approx(0.5 * fit.theta[:-1] @ fit.theta[:-1] + np.maximum(over, 0).sum(), rel=1e-9)


def test_wide_machines_take_long_blocks_and_solve_their_steps(spark, monkeypatch):
    """The curvature of a wide machine is summed over fewer, longer blocks, and its steps need no decomposition."""
    rng, names, packed = random.Random(10), [f"x{k}" for k in range(11)], []
    data = spark.createDataFrame([(*[rng.gauss(0, 1) + (c == "q") / 4 for _ in names], c) for c in (rng.choice("pq") for _ in range(900))],
                                 ", ".join(f"{n} double" for n in names) + ", class string")
    monkeypatch.setattr(M, "pack", lambda known, columns, rows, name: packed.append(rows) or pack(known, columns, rows, name))
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: pytest.fail("a curvature was decomposed"))
    for kernel, weights, length in (("poly", 287, 1024), ("linear", 12, 512)):
        fit, = M.svm(data, data, names, "class", kernel)[0].fits
        assert len(fit.theta) == weights and 0 <= fit.gap <= 1e-3 and packed.pop() == length


def test_zeros_of_a_sum_cost_nothing(monkeypatch):
    sums, values = np.zeros(2 * 3 * B.CHUNK, np.int64), np.zeros(3 * B.CHUNK)
    values[-1], rounded, kept = 1.5, [], np.rint
    monkeypatch.setattr(np, "rint", lambda x: rounded.append(x.size) or kept(x))
    B._add(sums, values, 3, len(values), True)
    assert sum(rounded) == 2 * B.CHUNK and sums[len(values) - 1] == B.COARSE / 2 and np.count_nonzero(sums) == 1
