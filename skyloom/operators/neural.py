"""Fully connected regression networks, any number of settings trained in the same passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import col
from .blocks import Blocks, pack, total


class Setting(NamedTuple):
    """One network: hidden layers, units in each, and the power of the target that weighs a row."""

    layers: int = 2
    width: int = 4
    weight_power: int = 0


class Networks(NamedTuple):
    """Trained parameters, one flat vector per setting, and how columns were scaled."""

    cols: list[str]
    centre: np.ndarray
    spread: np.ndarray
    settings: list[Setting]
    parameters: list[np.ndarray]
    history: list[list[float]]  # per setting the loss of each epoch
    held: list[float | None]  # per setting the loss on the validation rows


def layer_sizes(inputs: int, setting: Setting) -> list[int]:
    return [inputs, *[setting.width] * setting.layers, 1]


def initial(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Glorot-uniform weights and zero biases in one flat vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes[:-1], sizes[1:]):
        limit = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-limit, limit, a * b), np.zeros(b)]
    return np.concatenate(parts)


def pieces(parameters: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    shaped, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        shaped.append((parameters[at:at + a * b].reshape(a, b), parameters[at + a * b:at + a * b + b]))
        at += a * b + b
    return shaped


def forward(parameters: np.ndarray, sizes: Sequence[int], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers, the input first."""
    seen, shaped = [x], pieces(parameters, sizes)
    for k, (m, b) in enumerate(shaped):
        h = seen[-1] @ m
        h += b
        seen.append(np.maximum(h, 0.0, out=h) if k < len(shaped) - 1 else h)
    return seen


def gradient(parameters: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted absolute error and its gradient, summed over the rows."""
    seen, shaped = forward(parameters, sizes, x), pieces(parameters, sizes)
    miss = seen[-1][:, 0] - y
    delta, parts = (w * np.sign(miss))[:, None], []
    for k in range(len(shaped) - 1, -1, -1):
        parts[:0] = [(seen[k].T @ delta).ravel(), delta.sum(axis=0)]
        if k:
            delta = delta @ shaped[k][0].T
            delta *= seen[k] > 0
    return float((w * np.abs(miss)).sum()), np.concatenate(parts)


def batch_of(epoch: int, steps: int) -> Column:
    """The mini-batch of a block in an epoch: a hash, so that every epoch deals the blocks anew."""
    return F.pmod(F.xxhash64(F.lit(epoch), "block"), F.lit(steps))


def scaling(train: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation, to twelve digits: what the order of a sum leaves of differences doesn't reach the fit."""
    row = train.agg(*[F.avg(col(c).cast("double")) for c in cols], *[F.stddev_pop(col(c).cast("double")) for c in cols]).first()
    short = np.array([0.0 if v is None else float(f"{v:.12g}") for v in row])
    return short[:len(cols)], np.where(short[len(cols):] > 0, short[len(cols):], 1.0)


def train_networks(train: DataFrame, cols: Sequence[str], target: str, settings: Sequence[Setting], *, epochs: int = 25, steps: int = 4,
                   rate: float = 0.01, seed: int = 0, val: DataFrame | None = None) -> Networks:
    """Weighted mean-absolute-error regression with ReLU layers and Adam, for all ``settings`` at once.

    The rows are packed into blocks once. An epoch deals the blocks to ``steps``
    mini-batches by a hash; in a step every task holds the parameters of all
    settings, reads its blocks of the batch once and returns one gradient sum
    per setting, and the driver takes one Adam step per setting. Sums don't
    depend on the partitions, so neither do the weights, and a setting gets the
    same weights alone as among others. Memory and traffic of a step are in
    proportion to the number of parameters, not of rows.

    Rows with a null or not-a-number in a column or the target are left out; without any
    row the initial weights stay. The target must not be negative where
    ``weight_power`` isn't a whole number.
    """
    cols, settings = list(cols), [Setting(*s) for s in settings]
    sizes = [layer_sizes(len(cols), s) for s in settings]
    # settings of one shape start alike, as single fits do
    state = [initial(s, seed) for s in sizes]
    lengths = [len(p) for p in state]
    known = F.array(*[col(c).cast("double") for c in [*cols, target]])
    train = train.filter(F.forall(known, lambda v: v.isNotNull() & ~F.isnan(v)))
    centre, spread = scaling(train, cols)
    first = np.zeros(sum(lengths))
    second = np.zeros(sum(lengths))

    def packed(df: DataFrame, name: str) -> Blocks:
        return pack(df, {**{f"x{k}": col(c) for k, c in enumerate(cols)}, "y": col(target)}, name=name).cache()

    def rows_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return ((m[:, :-2] - centre) / spread).astype(np.float32), m[:, -2], m[:, -1]

    def learn(parameters: list[np.ndarray]):
        shared = ready.frame.sparkSession.sparkContext.broadcast([p.astype(np.float32) for p in parameters])

        def run(m: np.ndarray, block: int) -> np.ndarray:
            x, y, times = rows_of(m)
            out = []
            for p, size, s in zip(shared.value, sizes, settings):
                loss, g = gradient(p, size, x, y.astype(np.float32), (times * y ** s.weight_power).astype(np.float32))
                out += [g, [loss]]
            return np.concatenate([*out, [times.sum()]])
        return run, shared

    def judge(parameters: list[np.ndarray]):
        def run(m: np.ndarray, block: int) -> np.ndarray:
            x, y, times = rows_of(m)
            return np.array([*[(times * np.abs(forward(p, size, x)[-1][:, 0] - y)).sum() for p, size in zip(parameters, sizes)], times.sum()])
        return run

    ready = packed(train, "network-train")
    history: list[list[float]] = [[] for _ in settings]
    held: list[float | None] = [None] * len(settings)
    done = 0
    try:
        for epoch in range(epochs):
            losses, seen = np.zeros(len(settings)), 0.0
            for step in range(steps):
                run, shared = learn(state)
                got = total(ready, run, sum(lengths) + len(settings) + 1, batch_of(epoch, steps) == step, fine=False)
                shared.unpersist()
                n = got[-1]
                if not n:
                    continue
                done += 1
                at = moved = 0
                for k, length in enumerate(lengths):
                    g = got[at:at + length] / n
                    part = slice(moved, moved + length)
                    first[part] = 0.9 * first[part] + 0.1 * g
                    second[part] = 0.999 * second[part] + 0.001 * g * g
                    state[k] = state[k] - rate * (first[part] / (1 - 0.9 ** done)) / (np.sqrt(second[part] / (1 - 0.999 ** done)) + 1e-7)
                    losses[k] += got[at + length]
                    at, moved = at + length + 1, moved + length
                seen += n
            for k in range(len(settings)):
                history[k].append(float(losses[k] / max(seen, 1.0)))
        if val is not None:
            checked = packed(val, "network-check")
            try:
                got = total(checked, judge(state), len(settings) + 1)
                held = [float(v / max(got[-1], 1.0)) for v in got[:-1]]
            finally:
                checked.close()
    finally:
        ready.close()
    return Networks(cols, centre, spread, settings, state, history, held)


def predict(nets: Networks, df: DataFrame, which: int = 0, name: str = "prediction") -> DataFrame:
    """Rows with the prediction of one network; null where a column is."""
    sizes, parameters, centre, spread = layer_sizes(len(nets.cols), nets.settings[which]), nets.parameters[which], nets.centre, nets.spread

    @F.pandas_udf("double")
    def answer(x: pd.Series) -> pd.Series:
        rows = np.array([[np.nan if v is None else v for v in r] for r in x], dtype=np.float64).reshape(len(x), len(centre))
        out = forward(parameters, sizes, (rows - centre) / spread)[-1][:, 0]
        return pd.Series(out).where(~np.isnan(rows).any(axis=1), None)

    return df.withColumn(name, answer(F.array(*[col(c).cast("double") for c in nets.cols])))


def errors(nets: Networks, df: DataFrame, target: str, label: str) -> DataFrame:
    """Mean absolute error of every network per class and over all rows (class null), in one pass.

    ``setting`` is the position among the settings. A task adds its rows up, so
    the shuffle has a row per setting, class and task. Rows are dealt anew to all cores, as a file
    of one row group is read by one task.
    """
    sizes = [layer_sizes(len(nets.cols), s) for s in nets.settings]
    parameters, centre, spread = nets.parameters, nets.centre, nets.spread
    shared = df.sparkSession.sparkContext.broadcast(parameters)
    known = F.array(*[col(c).cast("double") for c in nets.cols], col(target).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], list[float]] = {}
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            classes = np.array(batch.column("label").to_pylist(), dtype=object)
            x, y = (rows[:, :-1] - centre) / spread, rows[:, -1]
            places = [(c, classes == c) for c in set(classes.tolist())]
            for k, (p, size) in enumerate(zip(shared.value, sizes)):
                miss = np.abs(forward(p, size, x)[-1][:, 0] - y)
                for c, own in places:
                    part = sums.setdefault((k, c), [0.0, 0.0])
                    part[0] += float(miss[own].sum())
                    part[1] += float(own.sum())
        yield pa.RecordBatch.from_pylist([{"setting": k, "label": c, "miss": m, "n": n} for (k, c), (m, n) in sums.items()],
                                         schema=pa.schema([("setting", pa.int32()), ("label", pa.string()), ("miss", pa.float64()), ("n", pa.float64())]))

    usable = df.select(known.alias("v"), F.coalesce(col(label).cast("string"), F.lit("")).alias("label")).filter(F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v)))
    dealt = usable.repartition(max(usable.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism))
    return (dealt.mapInArrow(run, "setting int, label string, miss double, n double").rollup("setting", "label")
            .agg((F.sum("miss") / F.sum("n")).alias("mae")).filter(F.col("setting").isNotNull()))


def mlp_regress(train: DataFrame, test: DataFrame, cols: Sequence[str], target: str, *, weight_power: int = 0, layers: int = 2,
                width: int = 4, epochs: int = 100, steps: int = 4, rate: float = 0.01, seed: int = 0, val: DataFrame | None = None):
    """One network of ``train_networks``.

    Returns (weights, scored test rows, history of the loss while training by
    epoch; -1 is the loss on ``val``).
    """
    nets = train_networks(train, cols, target, [Setting(layers, width, weight_power)], epochs=epochs, steps=steps, rate=rate, seed=seed, val=val)
    history = [(k + 1, v) for k, v in enumerate(nets.history[0])] + ([(-1, nets.held[0])] if val is not None else [])
    return nets.parameters[0], predict(nets, test), test.sparkSession.createDataFrame(history, "epoch int, loss double")


def network_sweep(train: DataFrame, test: DataFrame, cols: Sequence[str], target: str, label: str, classes: Mapping[str, str],
                  settings: Sequence[Setting], **options) -> DataFrame:
    """One row per setting: its values, history, validation loss, mean absolute error over all rows and per class.

    ``classes`` names the error column of each class. All settings are trained in
    the same passes and scored in one.
    """
    nets = train_networks(train, cols, target, settings, **options)
    schema = "setting int, nLayers int, nPerLayer int, weightPow int, history array<double>, val_loss double"
    table = train.sparkSession.createDataFrame([(k, *s, h, v) for k, (s, h, v) in enumerate(zip(nets.settings, nets.history, nets.held))], schema)
    scores = errors(nets, test, target, label).groupBy("setting").agg(
        F.max(F.when(F.col("label").isNull(), F.col("mae"))).alias("avg_err"),
        *[F.max(F.when(F.col("label") == c, F.col("mae"))).alias(n) for c, n in classes.items()])
    return table.join(scores, "setting", "left")
