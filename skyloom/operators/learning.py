"""Classification and regression."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.expr import add, col
from . import convex, trees
from .blocks import BLOCK_ROWS, pack
from .neural import scaling

_PREDICTION = "prediction"
WIDE = 256  # weights from which the sum of a block's curvature costs as much as its rows: blocks are twice as long


# --- naive Bayes -----------------------------------------------------------

def naive_bayes_model(train: DataFrame, cols: Sequence[str], label: str, weight: str | None = None,
                      alpha: float = 1.0) -> DataFrame:
    """One row per class: unsmoothed log prior and smoothed log feature shares.

    A single grouped aggregate with map-side combine; the shuffle carries one
    row of sums per class and task.
    """
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    sums = train.groupBy(col(label).alias("label")).agg(
        F.sum(w).alias("_w"), *[F.sum(w * col(c)).alias(f"_s{k}") for k, c in enumerate(cols)])
    total = F.sum("_w").over(W.partitionBy())  # one row per class
    mass = add(F.col(f"_s{k}") for k in range(len(cols))) + F.lit(alpha * len(cols))
    return sums.select(
        "label", F.log(F.col("_w") / total).alias("log_prior"),
        F.array(*[F.log((F.col(f"_s{k}") + F.lit(alpha)) / mass) for k in range(len(cols))]).alias("log_share"))


def naive_bayes_predict(df: DataFrame, model: DataFrame, cols: Sequence[str], name: str = _PREDICTION) -> DataFrame:
    """Most likely class per row, the first in label order on ties.

    The model (classes x features numbers) enters as a scalar subquery, so
    scoring is a projection without join or shuffle.
    """
    classes = model.agg(F.sort_array(F.collect_list(F.struct("label", "log_prior", "log_share"))).alias("m")).scalar()

    def joint(c: Column) -> Column:
        return c["log_prior"] + add(c["log_share"][k] * col(x) for k, x in enumerate(cols))

    scored = df.withColumn("_m", classes).withColumn("_s", F.transform("_m", joint))
    best = F.array_position("_s", F.array_max("_s")).cast("int")
    return scored.withColumn(name, F.element_at(F.transform("_m", lambda c: c["label"]), best)).drop("_m", "_s")


def naive_bayes(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, weight: str | None = None,
                alpha: float = 1.0) -> DataFrame:
    """Multinomial naive Bayes on bin numbers: the test rows with ``prediction``."""
    return naive_bayes_predict(test, naive_bayes_model(train, cols, label, weight, alpha), cols)


# --- linear machines --------------------------------------------------------

class Machines(NamedTuple):
    """Fitted machines: ``fits[k]`` belongs to ``pairs[k]`` (positions among ``labels``); logistic regression and regression have one."""

    cols: list[str]
    centre: np.ndarray
    spread: np.ndarray
    features: Callable[[np.ndarray], np.ndarray]
    labels: list
    pairs: list[tuple[int, int]]
    fits: list[convex.Fit]
    rows: int


def _usable(df: DataFrame, cols: Sequence[str], more: Column) -> DataFrame:
    known = F.array(*[col(c).cast("double") for c in cols])
    return df.filter(more.isNotNull() & F.forall(known, lambda v: v.isNotNull() & ~F.isnan(v)))


def _classes(df: DataFrame, label: str) -> tuple[list, Column]:
    """The classes in order, and the position of a row's class."""
    labels = sorted(r[0] for r in df.select(col(label)).distinct().collect() if r[0] is not None)  # one per class
    return labels, F.array_position(F.array(*[F.lit(x) for x in labels]), col(label)) - 1 if labels else F.lit(None).cast("int")


def _machines(train: DataFrame, cols: Sequence[str], target: Column, features: Callable[[np.ndarray], np.ndarray], losses: Sequence, penalty: np.ndarray,
              C: float | Sequence[float], labels: list, pairs: list, **limits) -> Machines:
    known = _usable(train, cols, target)
    centre, spread = scaling(known, cols)
    blocks = pack(known, {**{f"x{k}": col(c) for k, c in enumerate(cols)}, "y": target}, BLOCK_ROWS * (2 if len(penalty) > WIDE else 1), "machine-rows").cache()
    try:
        fits = convex.minimise(blocks, lambda x: features((x - centre) / spread), losses, penalty, C, **limits)
    finally:
        blocks.close()
    return Machines(list(cols), centre, spread, features, labels, pairs, fits, blocks.rows)


def _with_values(df: DataFrame, model: Machines, answer: Callable[[np.ndarray], np.ndarray], name: str, kind: str) -> DataFrame:
    """``answer`` of the mapped features of each row, null where a feature is null."""
    centre, spread, features = model.centre, model.spread, model.features

    @F.pandas_udf(kind)
    def value(*x: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy(np.float64, na_value=np.nan) for c in x])
        known = ~np.isnan(rows).any(axis=1)
        out = np.empty(len(rows), dtype=object)
        out[:] = None
        places = np.flatnonzero(known)
        for own in np.split(places, range(BLOCK_ROWS, len(places), BLOCK_ROWS)) if len(places) else ():
            for k, v in zip(own, answer(features((rows[own] - centre) / spread))):
                out[k] = v
        return pd.Series(out)

    return df.withColumn(name, value(*[col(c).cast("double") for c in model.cols]))


def _named(labels: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels or [None]]), place)


def logistic(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, C: float = 1.0, flat: float = 1e-10):
    """Multinomial logistic regression on standardised columns: ``|w|^2 / 2 + C`` times the log-loss, intercepts free.

    Newton steps to a gradient per row below ``flat``: one aggregate of gradient
    and Hessian a step, whose size depends on classes and columns alone. The
    scored rows have ``prediction`` and ``probabilities`` in class order; both
    are null where a feature is. Rows with a null in use are left out.
    """
    labels, code = _classes(train, label)
    features, q = convex.feature_map("linear", len(cols))
    penalty = np.tile(np.r_[np.ones(q - 1), 0.0], max(1, len(labels)))
    model = _machines(train, cols, code, features, [convex.Softmax(max(1, len(labels)))], penalty, C, labels, [], flat=flat)
    weights = model.fits[0].theta.reshape(-1, q)

    def shares(phi: np.ndarray) -> np.ndarray:
        z = phi @ weights.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    scored = _with_values(test, model, shares, "probabilities", "array<double>")
    place = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
    return model, scored.withColumn(_PREDICTION, _named(labels, place))


# --- trees ------------------------------------------------------------------

def decision_tree(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, **options):
    """Gini decision tree with exact thresholds, grown until leaves are pure; returns (model, predictions, labels)."""
    model = trees.fit(train, cols, label, **options)
    return model, trees.predict(model, test), model.labels


def random_forest(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, count: int = 100, tries: int | None = None, **options):
    """Forest of such trees on bootstraps, the square root of the features tried at a node unless given.

    Returns (model, predictions, importance per feature).
    """
    model = trees.fit(train, cols, label, trees=count, tries=tries or max(1, math.isqrt(len(cols))), **options)
    return model, trees.predict(model, test), trees.importances(model)


def tree_rules(model: trees.Forest, depth: int = 3) -> DataFrame:
    """The top of a fitted tree as rows: node, parent, depth, feature, threshold and majority class."""
    return trees.rules(model, depth).drop("counts")


def svm(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, kernel: str = "rbf", C: float = 1.0, degree: int = 3,
        gamma: float | None = None, gap: float = 1e-3, size: int = 128, seed: int = 0):
    """Support vector classifier on standardised columns, one class against one, by vote (the first class of equal votes).

    All pairs of classes are fitted in the same passes, each to a relative
    duality gap below ``gap``: its hinge losses are at the minimum up to that.
    ``linear`` and ``poly`` have the kernel's exact features, ``rbf`` ``size`` random
    Fourier features. Rows with a null in use are left out; a null feature has
    no prediction.
    """
    (model,), scored = svm_costs(train, test, cols, label, [C], kernel, degree=degree, gamma=gamma, gap=gap, size=size, seed=seed)
    return model, scored.withColumn(_PREDICTION, F.get("predictions", F.lit(0))).drop("predictions")


def svm_costs(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, costs: Sequence[float], kernel: str = "rbf", *, degree: int = 3,
              gamma: float | None = None, gap: float = 1e-3, size: int = 128, seed: int = 0) -> tuple[list[Machines], DataFrame]:
    """``svm`` for every one of ``costs`` at once: rows are packed once, and a pass serves all machines.

    Returns a model per cost, and the test rows with their ``predictions`` in the
    order of ``costs``. A machine is the same alone as among others.
    """
    labels, code = _classes(train, label)
    features, q = convex.feature_map(kernel, len(cols), degree=degree, gamma=gamma, size=size, seed=seed)
    pairs = list(combinations(range(len(labels)), 2))
    losses, each = [convex.Hinge(*p) for _ in costs for p in pairs], [c for c in costs for _ in pairs]
    whole = _machines(train, cols, code, features, losses, np.r_[np.ones(q - 1), 0.0], each, labels, pairs, gap=gap)
    models = [whole._replace(fits=whole.fits[k * len(pairs):(k + 1) * len(pairs)]) for k in range(len(costs))]
    weights = np.array([f.theta for f in whole.fits]).reshape(len(costs), len(pairs), q)

    def vote(phi: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(phi), len(costs), max(1, len(labels))), int)
        sides = (phi @ weights.reshape(-1, q).T > 0).reshape(len(phi), len(costs), len(pairs))
        for k, (a, b) in enumerate(pairs):
            votes[:, :, b] += sides[:, :, k]
            votes[:, :, a] += ~sides[:, :, k]
        return votes.argmax(axis=2)

    scored = _with_values(test, models[0], vote, "_places", "array<int>")
    return models, scored.withColumn("predictions", F.transform("_places", lambda k: _named(labels, k))).drop("_places")


def certificates(model: Machines) -> DataFrame:
    """One row per machine: its classes, primal and dual value, relative gap, gradient per row and passes over the rows."""
    rows = [(*[None if not model.pairs else str(model.labels[p]) for p in (model.pairs[k] if model.pairs else (0, 0))], float(f.primal), float(f.dual), float(f.gap), float(f.slope), f.passes)
            for k, f in enumerate(model.fits)]
    return SparkSession.active().createDataFrame(rows, "negative string, positive string, primal double, dual double, gap double, slope double, passes int")


# --- linear support vector regression ---------------------------------------

def linear_svr(train: DataFrame, test: DataFrame, cols: Sequence[str], target: str, C: float = 1.0, epsilon: float = 0.0, gap: float = 1e-3):
    """Linear support vector regression on standardised columns: ``|w|^2 / 2 + C sum max(0, |y - w x| - epsilon)``, where x ends in a 1.

    Newton steps on a smoothed loss until the relative duality gap is below
    ``gap``. Returns (model, scored rows); ``model.fits[0]`` has weights and gap.
    """
    features, q = convex.feature_map("linear", len(cols))
    model = _machines(train, cols, col(target).cast("double"), features, [convex.Insensitive(epsilon)], np.ones(q), C, [], [], gap=gap)
    weights = model.fits[0].theta
    return model, _with_values(test, model, lambda phi: phi @ weights, _PREDICTION, "double")


# --- sweeps ------------------------------------------------------------------

def sweep(fit: Callable[..., float | Mapping[str, float]], grid: Iterable[Mapping[str, object]],
          datasets: Mapping[str, object], schema: str, at_once: int = 8, together: bool = False) -> DataFrame:
    """Run ``fit(dataset, **point)`` for every grid point and data set; one row of settings and scores each.

    Every fit is a distributed job of its own, ``at_once`` of them side by side;
    the driver keeps one row per fit. With ``together`` a call is
    ``fit(dataset, points)`` and returns the scores of all grid points in order.
    """
    grid = list(grid)
    tasks = [(name, data, points) for name, data in datasets.items() for points in ([grid] if together else [[point] for point in grid])]

    def run(task) -> list[dict]:
        name, data, points = task
        found = fit(data, points) if together else [fit(data, **points[0])]
        return [{"file": name, **point, **(scores if isinstance(scores, Mapping) else {"score": scores})} for point, scores in zip(points, found, strict=True)]

    with ThreadPoolExecutor(at_once) as pool:
        rows = [row for part in pool.map(inheritable_thread_target(SparkSession.active())(run), tasks) for row in part]
    return SparkSession.active().createDataFrame(rows, schema)
