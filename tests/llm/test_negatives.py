"""Hard negatives: the index and its bounds, and whole results against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import negatives

LAYOUT = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, shares=(50, 95), keep=3, every=50):
    fine = {(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in fine]
    out = []
    for i, v, lab in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in whole if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            window = [x for x in scored if x[2] != lab and shares[0] * -s <= -100 * x[0] <= shares[1] * -s]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(window[:keep])]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, LAYOUT)
    return sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, **kw).collect())


def vectors(rng, n, dims=8, centres=6):
    middle = rng.normal(size=(centres, dims))
    return [(i, [float(x) for x in (middle[rng.integers(centres)] + 0.3 * rng.normal(size=dims)) / 3], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("first", [1, 2048])
def test_equal_to_all_pairs(spark, first):
    rows = vectors(np.random.default_rng(1), 1200)
    assert mined(spark, rows, first=first, cell_rows=16, anchors_a_block=8) == brute(rows)


def test_shared_vectors_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(2)
    rows = vectors(rng, 400)
    same = [0.5] * 8
    rows += [(1000 + i, same, i % 3) for i in range(300)]  # one vector of very many rows: ties by identifier
    rows += [(50, [float("nan")] * 8, 0), (100, None, 1), (150, [None] * 8, 1), (None, same, 1), (200, [float("inf")] * 8, 1), (250, same, None)]
    rows += [(2000, same, 1)] * 50  # repeated rows count once
    rows += [(2050, [0.0] * 8, 0), (2100, [-0.5] * 8, 1), (2150, [0.25] * 3, 2), (2200, [], 2)]
    padded = [(i, None if v is None else v + [0.0] * (8 - len(v)), lab) for i, v, lab in rows]
    assert mined(spark, rows, cell_rows=32, first=40) == brute(padded)


def test_visits_fall_and_reach_every_cell():
    rng = np.random.default_rng(3)
    left, right = rng.normal(size=13), rng.normal(size=9)
    seen = list(negatives.visit(left, right))
    assert sorted((i, j) for _, i, j in seen) == [(i, j) for i in range(13) for j in range(9)]
    assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:])) and all(abs(s - left[i] - right[j]) < 1e-9 for s, i, j in seen)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    centres = 200 * rng.normal(size=(30, 16))
    points = np.round(centres[rng.integers(30, size=3000)] + 3 * rng.normal(size=(3000, 16)))
    books = negatives.Codebooks((negatives.lloyd(points[:, :8], 30), negatives.lloyd(points[:, 8:], 30)), 16)
    codes = [negatives.nearest(p, b) for p, b in zip(books.split(points), books.halves)]
    radii = tuple(np.array([np.sqrt(((p[c == k] - b[k]) ** 2).sum(1)).max(initial=0) for k in range(30)]) for p, b, c in zip(books.split(points), books.halves, codes))
    counts = np.zeros((30, 30), int)
    np.add.at(counts, tuple(codes), 1)
    cells = negatives.Cells(counts, radii)
    bounds = negatives.half_bounds(points[:5], books, cells)
    scores = points[:5] @ points.T
    assert (bounds[0][:, codes[0]] + bounds[1][:, codes[1]] >= scores - 1e-6).all()
    least = np.sort(scores, axis=1)[:, -10]
    cells_at = codes[0] * 30 + codes[1]
    for q in range(5):
        opened = negatives.wanted_cells(points[q:q + 1], books, cells, 50, None)
        rest = negatives.wanted_cells(points[q:q + 1], books, cells, 50, least[q:q + 1])
        assert set(cells_at[scores[q] >= least[q]].tolist()) <= opened | rest and not opened & rest
        assert len(opened | rest) < (counts > 0).sum() / 2


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2 ** 18 + random.Random(i).randrange(64)), float(i)], i % 2) for i in range(200)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_clashing_names(spark):
    rows = vectors(np.random.default_rng(5), 120)
    df = spark.createDataFrame(rows, LAYOUT)
    clash = df.withColumns({"anchor": F.lit("x"), "v": F.lit(1), "cell": F.lit(None).cast("int"), "block": F.lit(2)})
    assert sorted(tuple(r) for r in negatives.mine(clash, F.col("vec_id") % 50 == 0).collect()) == brute(rows)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.mine(df, F.lit(False)).count() == 0
