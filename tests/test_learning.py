"""Models and clusters on small frames with known answers."""

import math
import random

import numpy as np
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import clustering as G
from skyloom.operators import learning as M


def _blobs(spark, n=300, seed=1):
    rng = random.Random(seed)
    centres = {"a": (0, 0), "b": (6, 0), "c": (0, 6)}
    rows = [(k, c, x + rng.gauss(0, 0.7), y + rng.gauss(0, 0.7)) for k in range(n) for c, (x, y) in [rng.choice(list(centres.items()))]]
    return spark.createDataFrame(rows, "row_id long, class string, x double, y double").repartition(3), rows


def test_naive_bayes_matches_the_definition(spark):
    train = [("p", 1, 4), ("p", 2, 5), ("q", 5, 1)]
    df = spark.createDataFrame(train, "label string, f int, g int")
    model = {r.label: r for r in M.naive_bayes_model(df, ["f", "g"], "label").collect()}
    assert model["p"].log_prior == pytest.approx(math.log(2 / 3))
    assert model["p"].log_share == pytest.approx([math.log(4 / 14), math.log(10 / 14)])
    test = spark.createDataFrame([(1, 5), (5, 1)], "f int, g int")
    assert [r.prediction for r in M.naive_bayes_predict(test, M.naive_bayes_model(df, ["f", "g"], "label"), ["f", "g"]).collect()] == ["p", "q"]


@pytest.mark.parametrize("blocks", [1, 5])
def test_silhouette_is_exact(spark, blocks):
    df, rows = _blobs(spark, 90)
    got = G.silhouette(df.withColumn("cluster", F.ascii("class")), ["x", "y"], blocks=blocks).first()[0]
    x = np.array([r[2:] for r in rows])
    label = np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    widths = []
    for i in range(len(x)):
        own = label == label[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == o].mean() for o in set(label) - {label[i]})
        widths.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(widths))


def test_silhouette_of_close_rows_far_from_others(spark):
    """Products of long vectors lose the digits of short distances."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(40, 3)) * 1e-4 + far for far in (0.0, 2e-3, 1e4)])
    x[5], label = x[4], np.repeat([0, 1, 2], 40)
    df = spark.createDataFrame([(k, int(c), *map(float, r)) for k, (c, r) in enumerate(zip(label, x))], "row_id long, cluster int, x double, y double, z double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    own = np.array([d[i, label == label[i]].sum() / 39 for i in range(120)])
    other = np.array([min(d[i, label == o].mean() for o in {0, 1, 2} - {label[i]}) for i in range(120)])
    assert G.silhouette(df, ["x", "y", "z"]).first()[0] == pytest.approx(((other - own) / np.maximum(own, other)).mean(), rel=1e-9)


def test_copies_of_a_row_are_bounded():
    """A row is copied once a block: short blocks would make a thousand copies of half a million rows."""
    assert G._block_count(524_288, 64, 512, 12) == 64 and G._block_count(40_000, 64, 512, 12) == 8
    assert G._block_count(500, 64, 512, 12) == 1 and G._block_count(5_000, 64, 512, 12) <= 10 and G._block_count(0, 1, 512, 12) == 1


def test_choice_of_k_and_lift(spark):
    df, _ = _blobs(spark)
    scores, (assigned, centres, _) = G.select_k(df, ["x", "y"], range(2, 5), seed=3, normalise=True)
    assert scores.where("best").first().k == 3 and centres.count() == 3
    lift = G.cluster_class_lift(assigned).collect()
    assert len(lift) == 9
    assert sorted(round(r.lift, 6) for r in lift)[:6] == [-1.0] * 6


def test_ward_merges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 3))
    data = np.column_stack([base[:, 0], base[:, 0] + 0.1 * rng.normal(size=200), base[:, 1], base[:, 1] + 0.5 * rng.normal(size=200), base[:, 2]])
    cols = list("abcde")
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], ", ".join(f"{c} double" for c in cols))
    z = (data - data.mean(0)) / data.std(0, ddof=1)
    cosine = (z.T @ z) / np.sqrt(np.outer((z * z).sum(0), (z * z).sum(0)))
    merges = G.feature_dendrogram(df, cols).orderBy("step").collect()
    assert (merges[0].left, merges[0].right) == ("a", "b") and merges[0].height == pytest.approx(1 - cosine[0, 1])
    assert (merges[1].left, merges[1].right) == ("c", "d") and merges[-1].size == 5
    assert [m.height for m in merges] == sorted(m.height for m in merges)


@pytest.mark.parametrize("kernel", ["linear", "poly", "rbf"])
def test_svm_separates_blobs(spark, kernel):
    df, _ = _blobs(spark)
    train, test = df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    _, scored = M.svm(train, test, ["x", "y"], "class", kernel, size=32)
    assert scored.where("class = prediction").count() / scored.count() > 0.95


def test_trees_and_logistic(spark):
    df, _ = _blobs(spark)
    train, test = df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    model, scored, labels = M.decision_tree(train, test, ["x", "y"], "class")
    assert scored.where("class = prediction").count() / scored.count() > 0.9
    assert labels == ["a", "b", "c"]
    rules = M.tree_rules(model, 1).orderBy("node").collect()
    assert rules[0].depth == 0 and rules[0].feature in ("x", "y") and max(r.depth for r in rules) == 1
    _, scored, importance = M.random_forest(train, test, ["x", "y"], "class", count=5)
    assert sum(r.importance for r in importance.collect()) == pytest.approx(1.0)
    _, scored = M.logistic(train, test, ["x", "y"], "class")
    assert scored.where("class = prediction").count() / scored.count() > 0.95


def test_support_vector_regression_ignores_outliers(spark):
    rng = random.Random(5)
    rows = [(x, 2 * x + 1 + (500.0 if k % 10 == 0 else 0.0)) for k in range(200) for x in [rng.uniform(0, 10)]]
    df = spark.createDataFrame(rows, "x double, y double")
    _, scored = M.linear_svr(df, df.where("y < 100"), ["x"], "y")
    worst = scored.agg(F.max(F.abs(F.col("y") - F.col("prediction")))).first()[0]
    assert worst < 0.2


def test_sweep_keeps_one_row_per_fit(spark):
    out = M.sweep(lambda data, C: data * C, [{"C": 1.0}, {"C": 2.0}], {"one": 1.0, "two": 2.0}, "file string, C double, score double")
    assert sorted((r.file, r.C, r.score) for r in out.collect()) == [("one", 1.0, 1.0), ("one", 2.0, 2.0), ("two", 1.0, 2.0), ("two", 2.0, 4.0)]


def _plain_silhouette(x, label):
    square = ((x[:, None] - x[None]) ** 2).sum(2)
    widths = []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() < 2:
            widths.append(0.0)
            continue
        a = square[i, same].sum() / (same.sum() - 1)
        b = min(square[i, label == c].mean() for c in set(label.tolist()) - {own})
        widths.append((b - a) / max(a, b))
    return float(np.mean(widths))


def test_every_k_in_one_pass_equals_plain_numpy(spark):
    df, rows = _blobs(spark, 240, seed=9)
    x = np.array([r[2:] for r in rows])
    tables = []
    for parts in (1, 5):
        table, (assigned, named, centres) = G.select_k(df.repartition(parts), ["x", "y"], range(2, 7), seed=3)
        tables.append({r["k"]: r["score"] for r in table.collect()})
    assert tables[0] == tables[1] and [r["k"] for r in table.collect() if r["best"]] == [3] and named.count() == 3
    label = np.array([r["cluster"] for r in assigned.orderBy("row_id").collect()])
    assert tables[0][3] == pytest.approx(_plain_silhouette(x, label))
    for c in range(3):
        assert np.allclose(centres[c], x[label == c].mean(axis=0), atol=1e-4)
    packed = G.pack(df, {"x": F.col("x"), "y": F.col("y")}, block_rows=40)
    starts = [x[:k] for k in (2, 4, 5)]
    together = G.lloyd(packed, starts)
    for start, got in zip(starts, together):
        want = start
        for _ in range(300):
            near = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
            want = np.array([x[near == c].mean(0) if (near == c).any() else want[c] for c in range(len(want))])
        assert np.allclose(got, want, atol=1e-2) and (G.lloyd(packed, [start])[0] == got).all()
        label = ((x[:, None] - got[None]) ** 2).sum(2).argmin(1)
        assert G.squared_silhouettes(packed, [got])[0] == pytest.approx(_plain_silhouette(x, label))


def test_select_k_with_nulls_and_without_rows(spark):
    df, _ = _blobs(spark, 90, seed=10)
    more = df.union(spark.createDataFrame([(1000, "a", None, 1.0)], "row_id long, class string, x double, y double"))
    table, (assigned, _, _) = G.select_k(more, ["x", "y"], (2, 3), normalise=True, thin=0.7)
    assert table.count() == 2 and assigned.filter("cluster IS NULL").count() == 1 and assigned.count() == 91
    assert G.select_k(df.limit(0), ["x", "y"], (2, 3))[0].count() == 2


def test_kmeans_deals_its_vectors_to_tasks_of_bounded_size(spark, monkeypatch):
    """Rows that all come in one partition, the others empty, aren't kept by one task."""
    class Watched(G.KMeans):
        def fit(self, df):
            sizes.append([r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()])
            return super().fit(df)

    sizes = []
    monkeypatch.setattr(G, "KMeans", Watched), monkeypatch.setattr(G, "TASK_BYTES", 108 * 100, raising=False)
    df = spark.range(0, 20000, 1, 20).filter("id < 1000").select(F.col("id").alias("row_id"), (F.col("id") % 10 + F.when(F.col("id") < 400, 0).otherwise(5000)).cast("double").alias("x"))
    assigned, centres, _ = G.kmeans(df, ["x"], 2, seed=7)
    assert sum(sizes[0]) == 1000 and max(sizes[0]) <= 110
    assert sorted(r["n"] for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()) == [400, 600]
    assert sorted(r["x"] for r in centres.collect()) == [4.5, 5004.5]
