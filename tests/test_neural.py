"""Networks against plain numpy, on any number of partitions, alone and among others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import neural as N
from skyloom.operators.blocks import matrix, pack, total

COLS = ["a", "b"]
GRID = [N.Setting(1, 3, 0), N.Setting(2, 4, 1), N.Setting(1, 3, 2), N.Setting(3, 5, 2)]


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.gauss(0, 2), float(rng.randrange(5)), "xyz"[k % 3]) for k in range(n)]


def frame(spark, data, parts=3):
    return spark.createDataFrame([(a, b, abs(a - b / 2) + 0.1, c) for a, b, c in data], "a double, b double, y double, class string").repartition(parts)


def plain(data, setting, epochs, rate, seed):
    """Full-batch Adam over all rows in one matrix."""
    x = np.array([r[:2] for r in data])
    y = np.abs(x[:, 0] - x[:, 1] / 2) + 0.1
    x = (x - x.mean(0)) / x.std(0)
    sizes = N.layer_sizes(2, setting)
    p = N.initial(sizes, seed)
    m = v = np.zeros_like(p)
    for t in range(1, epochs + 1):
        ws, at, hs, zs = [], 0, [x], []
        for a, b in zip(sizes[:-1], sizes[1:]):
            ws.append((p[at:at + a * b].reshape(a, b), p[at + a * b:at + a * b + b]))
            at += a * b + b
        for k, (w, b) in enumerate(ws):
            zs.append(hs[-1] @ w + b)
            hs.append(np.maximum(zs[-1], 0) if k < len(ws) - 1 else zs[-1])
        d = ((y ** setting.weight_power) * np.sign(hs[-1][:, 0] - y))[:, None] / len(y)
        g = []
        for k in range(len(ws) - 1, -1, -1):
            g = [(hs[k].T @ d).ravel(), d.sum(0), *g]
            if k:
                d = (d @ ws[k][0].T) * (zs[k - 1] > 0)
        g = np.concatenate(g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-7)
    return p


def test_equal_to_plain_numpy(spark):
    data = rows(900, 1)
    nets = N.train_networks(frame(spark, data), COLS, "y", GRID[:2], epochs=12, steps=1, rate=0.01, seed=4)
    for got, setting in zip(nets.parameters, GRID):
        assert np.abs(got - plain(data, setting, 12, 0.01, 4)).max() < 1e-3  # single precision inside blocks, and kinks


def test_weights_do_not_depend_on_partitions_or_company(spark):
    data = rows(1500, 2)
    fits = [N.train_networks(frame(spark, data, parts), COLS, "y", GRID, epochs=3, steps=3, seed=1) for parts in (1, 3, 8)]
    for other in fits[1:]:
        assert all((a == b).all() for a, b in zip(fits[0].parameters, other.parameters)) and other.history == fits[0].history
    for k, setting in enumerate(GRID):
        alone = N.train_networks(frame(spark, data), COLS, "y", [setting], epochs=3, steps=3, seed=1)
        assert (alone.parameters[0] == fits[0].parameters[k]).all() and alone.history[0] == fits[0].history[k]


def test_sweep_rows_equal_single_fits(spark):
    train, test = frame(spark, rows(600, 3)), frame(spark, rows(300, 4))
    out = {r["setting"]: r for r in N.network_sweep(train, test, COLS, "y", "class", {"x": "x_err", "y": "y_err", "z": "z_err"}, GRID, epochs=2, val=test).collect()}
    assert len(out) == len(GRID)
    for k, s in enumerate(GRID):
        _, scored, history = N.mlp_regress(train, test, COLS, "y", weight_power=s.weight_power, layers=s.layers, width=s.width, epochs=2, val=test)
        miss = F.avg(F.abs(F.col("y") - F.col("prediction")))
        by_class = {r[0]: r[1] for r in scored.groupBy("class").agg(miss).collect()}
        r = out[k]
        assert (r["nLayers"], r["nPerLayer"], r["weightPow"]) == s
        assert r["avg_err"] == pytest.approx(scored.agg(miss).first()[0]) and r["avg_err"] == pytest.approx(r["val_loss"])
        assert [r["x_err"], r["y_err"], r["z_err"]] == pytest.approx([by_class[c] for c in "xyz"])
        assert r["history"] == [h["loss"] for h in history.orderBy("epoch").collect() if h["epoch"] > 0]


def test_learns_and_skips_unusable_rows(spark):
    data = [(x, 0.0, 3 * x + 2, "x") for x in (random.Random(6).uniform(-1, 1) for _ in range(300))]
    df = spark.createDataFrame(data + [(None, 0.0, 1.0, "x"), (1.0, 0.0, None, "x"), (float("nan"), 0.0, 1.0, "x")], "a double, b double, y double, class string")
    _, scored, history = N.mlp_regress(df, df, ["a"], "y", layers=1, width=8, epochs=60, rate=0.05, val=df)
    losses = {r.epoch: r.loss for r in history.collect()}
    assert losses[60] < losses[1] / 5 and -1 in losses
    got = scored.agg(F.avg(F.abs(F.col("y") - F.col("prediction"))), F.count_if(F.col("prediction").isNull())).first()
    assert got[0] < 0.5 and got[1] == 2


def test_empty_table_keeps_the_first_weights(spark):
    nets = N.train_networks(frame(spark, rows(5, 1)).limit(0), COLS, "y", GRID[:1], epochs=2)
    assert (nets.parameters[0] == N.initial(N.layer_sizes(2, GRID[0]), 0)).all()


def test_blocks_hold_every_row_once(spark):
    data = [(float(k % 700), float(k % 3)) for k in range(2100)] + [(7.0, 7.0)] * 4000 + [(None, 1.0)]
    df = spark.createDataFrame(data, "a double, b double")
    sums = []
    for parts in (1, 5):
        blocks = pack(df.repartition(parts), {"a": F.col("a"), "b": F.col("b")}, block_rows=64)
        assert blocks.rows == 6100 and blocks.frame.agg(F.max("n")).first()[0] < 130
        sums.append(total(blocks, lambda m, block: np.concatenate([m[:, -1] @ m[:, :2], [m[:, -1].sum()], 0.1 * m[:, -1:].sum(0)]), 4))
        seen = [tuple(v) for r in blocks.frame.collect() for v in matrix(r["data"], 2)]
        assert sum(v[2] for v in seen) == 6100 and len(seen) == len({v[:2] for v in seen}) == 2101
    assert (sums[0] == sums[1]).all() and sums[0][:3] == pytest.approx([sum(a for a, _ in data[:-1]), sum(b for _, b in data[:-1]), 6100])


def test_chunked_sums_equal_direct_ones(spark, monkeypatch):
    import skyloom.operators.blocks as B
    df = spark.range(500).select(F.col("id").cast("double").alias("a"))
    blocks = pack(df, {"a": F.col("a")}, block_rows=40)

    def wide(m, block):
        return np.outer(m[:, 0], np.ones(7)).sum(0).repeat(50) * np.arange(350)

    direct = total(blocks, wide, 350, fine=False)
    monkeypatch.setattr(B, "CHUNK", 64), monkeypatch.setattr(B, "DIRECT", 1)
    assert (total(blocks, wide, 350, fine=False) == direct).all() and direct == pytest.approx(sum(range(500)) * np.arange(350))
    with pytest.raises(Exception):
        total(blocks, lambda m, block: np.array([np.inf]), 1)


def test_blocks_are_dealt_to_all_cores(spark):
    """However few files or partitions the rows come from; sums of several chunks and the zeros behind a short one are right."""
    slots = spark.sparkContext.defaultParallelism
    df = spark.range(0, 40 * 64 * slots, 1, 1).select(F.col("id").cast("double").alias("a"))
    blocks = pack(df, {"a": F.col("a")}, block_rows=64)
    held = [r["n"] for r in blocks.frame.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("n").alias("n")).collect()]
    assert len(held) == slots and max(held) < 1.5 * blocks.rows / slots
    got = total(blocks, lambda m, block: np.r_[np.zeros(70000), m[:, 0].sum()], 70003)
    assert got[70000] == pytest.approx(blocks.rows * (blocks.rows - 1) / 2) and not got[:70000].any() and not got[70001:].any()
