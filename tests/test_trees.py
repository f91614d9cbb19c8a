"""Exact trees against a plain search, on one task and split by Spark."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.operators import trees as T

COLS = ["a", "b", "c"]


def table(n, seed, values=12, classes="pqr"):
    rng = random.Random(seed)
    return [(rng.randrange(values) / 4, float(rng.randrange(values // 3)), rng.gauss(0, 1) if rng.random() < 0.5 else 0.0, rng.choice(classes)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "a double, b double, c double, class string").repartition(3)


def squares(counts):
    return sum(c * c for c in counts.values()) / sum(counts.values())


def plain_tree(rows, labels, depth=0):
    """Nested (feature, threshold, gain, left, right), or the weights by class."""
    counts = Counter(r[-1] for r in rows)
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:]):
            t = (lo + hi) / 2
            left, right = Counter(r[-1] for r in rows if r[f] <= t), Counter(r[-1] for r in rows if r[f] > t)
            score = squares(left) + squares(right)
            if best is None or score > best[0]:
                best = (score, f, t)
    if len(counts) < 2 or best is None:
        return tuple(counts[x] for x in labels)
    score, f, t = best
    return f, t, score - squares(counts), plain_tree([r for r in rows if r[f] <= t], labels), plain_tree([r for r in rows if r[f] > t], labels)


def nested(model, tree=0):
    nodes = [r for r in T.node_table(model).collect() if r["tree"] == tree]
    kids = {(r["parent"], r["side"]): r for r in nodes if r["parent"] is not None}
    assert len({r["node"] for r in nodes}) == len(nodes)

    def build(r):
        if r["feature"] is None:
            return tuple(int(c) for c in r["counts"])
        return r["feature"], r["threshold"], r["gain"], build(kids[r["node"], 0]), build(kids[r["node"], 1])

    return build(next(r for r in nodes if r["parent"] is None))


def close(a, b):
    if len(a) != 5 or len(b) != 5 or isinstance(a[3], int):
        return a == b
    return a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) and close(a[3], b[3]) and close(a[4], b[4])


@pytest.mark.parametrize("local_rows", [65536, 25])
def test_splits_equal_a_plain_search(spark, local_rows):
    rows = table(300, 1)
    model = T.fit(frame(spark, rows), COLS, "class", local_rows=local_rows)
    assert (model.levels > 0) == (local_rows == 25)
    assert close(nested(model), plain_tree(rows, model.labels))


def test_ties_take_the_first_feature_then_the_lowest_threshold(spark):
    rows = [(float(x), float(x), float(-x), "pq"[x % 2]) for x in range(8)]
    for local_rows in (100, 2):
        assert close(nested(T.fit(frame(spark, rows), COLS, "class", local_rows=local_rows)), plain_tree(rows, ["p", "q"]))


def test_deeper_than_any_fixed_limit(spark):
    """Each split can part only the end: class alternates in ever narrower steps that pay most at one side."""
    rows = [(float(x), 0.0, 0.0, "p" if x % 2 else "q") for x in range(400)]
    model = T.fit(frame(spark, rows), COLS, "class")
    assert T.node_table(model).agg(F.max("depth")).first()[0] > 30
    right = T.predict(model, frame(spark, rows)).filter("class = prediction").count()
    assert right == 400


def test_predictions_follow_the_tree(spark):
    rows, asked = table(400, 2), table(300, 3)
    asked += [(None, 0.0, 0.0, "p"), (float("nan"), 0.0, 0.0, "p"), asked[0], asked[0]]

    def walk(node, row):
        while len(node) == 5 and not isinstance(node[3], int):
            node = node[3] if row[node[0]] <= node[1] else node[4]
        return "pqr"[node.index(max(node))]

    tree = plain_tree(rows, "pqr")
    for local_rows in (65536, 30):
        model = T.fit(frame(spark, rows), COLS, "class", local_rows=local_rows)
        got = T.predict(model, frame(spark, asked), slice_rows=40).collect()
        assert len(got) == len(asked)
        for r in got:
            assert r["prediction"] == (None if r["a"] is None or r["a"] != r["a"] else walk(tree, r[:3]))


def test_forest_is_the_same_however_it_is_grown(spark):
    rows = table(600, 4, values=40)
    one = T.fit(frame(spark, rows), COLS, "class", trees=5, tries=1, seed=3)
    two = T.fit(frame(spark, rows).repartition(7), COLS, "class", trees=5, tries=1, seed=3, local_rows=40)
    assert two.levels > 1
    for tree in range(5):
        assert nested(one, tree) == nested(two, tree)
    assert len({str(nested(one, t)) for t in range(5)}) == 5


def test_importances_are_the_impurity_decrease(spark):
    rows = table(500, 5)
    model = T.fit(frame(spark, rows), COLS, "class", trees=4, tries=2, seed=1)
    nodes = T.node_table(model).collect()
    kids = defaultdict(list)
    for r in nodes:
        kids[r["tree"], r["parent"]].append(r)

    def impurity(c):
        return sum(c) * (1 - sum((x / sum(c)) ** 2 for x in c))

    want = Counter()
    for tree in range(4):
        own = Counter()
        for r in nodes:
            if r["tree"] == tree and r["feature"] is not None:
                own[r["feature"]] += impurity(r["counts"]) - sum(impurity(k["counts"]) for k in kids[tree, r["node"]])
        for f, v in own.items():
            want[f] += v / sum(own.values()) / 4
    got = {r["feature"]: r["importance"] for r in T.importances(model).collect()}
    assert got == pytest.approx({c: want[k] for k, c in enumerate(COLS)}) and sum(got.values()) == pytest.approx(1)


def test_bootstraps_have_the_weight_of_the_table(spark):
    model = T.fit(frame(spark, table(2000, 6)), COLS, "class", trees=20, tries=2, seed=2)
    roots = [sum(r["counts"]) for r in T.node_table(model).filter("parent IS NULL").collect()]
    assert len(roots) == 20 and abs(sum(roots) / 20 - 2000) < 60 and len(set(roots)) > 10


def test_edges(spark):
    rows = [(1.0, 1.0, 1.0, "p")] * 50 + [(1.0, 1.0, 1.0, "q")] * 50 + [(None, 1.0, 1.0, "q"), (1.0, 1.0, 2.0, None)]
    model = T.fit(frame(spark, rows), COLS, "class", local_rows=1)
    assert nested(model) == (50, 50)
    assert {r["prediction"] for r in T.predict(model, frame(spark, rows[:3])).collect()} == {"p"}
    large = T.fit(frame(spark, [(float(k % 90), 0.0, 0.0, "p" if k % 90 < 80 else "q") for k in range(900)]), COLS, "class", local_rows=20)
    assert nested(large)[0:2] == (0, 79.5) and T.predict(large, frame(spark, [(79.0, 0.0, 0.0, "p"), (80.0, 0.0, 0.0, "q")])).filter("class = prediction").count() == 2
    empty = T.fit(frame(spark, rows).limit(0), COLS, "class")
    assert [r["prediction"] for r in T.predict(empty, frame(spark, rows[:1])).collect()] == [None]
    assert [tuple(r)[:5] for r in T.rules(model, 2).collect()] == [(1, None, 0, None, None)] and T.rules(empty).count() == 0


def test_levels_cost_few_jobs(spark):
    rows = [(float(k), 0.0, 0.0, "pq"[k % 2]) for k in range(600)]  # the best cut peels one row off an end
    context, before = spark.sparkContext, {}
    try:
        for name, work in {"fit": lambda: T.fit(frame(spark, rows), COLS, "class", local_rows=580), "predict": lambda: T.predict(before["fit"], frame(spark, rows))}.items():
            context.setJobGroup(f"tree-{name}", name)
            before[name] = work()
        assert before["fit"].levels >= 15
        assert len(context.statusTracker().getJobIdsForGroup("tree-fit")) <= 4 * before["fit"].levels + 25
        assert len(context.statusTracker().getJobIdsForGroup("tree-predict")) <= 15
        assert before["predict"].filter("class = prediction").count() == 600
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_a_threshold_stays_below_the_value_behind_it(spark):
    rows = [(1.0 - 2.0 ** -53, 0.0, 0.0, "p"), (1.0, 0.0, 0.0, "q")] * 3  # their middle rounds to 1
    for local_rows in (1, 100):
        model = T.fit(frame(spark, rows), COLS, "class", local_rows=local_rows)
        assert T.predict(model, frame(spark, rows)).filter("class = prediction").count() == 6


def test_a_level_moves_cells_and_not_rows(spark):
    """What a level shuffles is bounded by cells of tasks; rows of finished nodes are not read again."""
    rows = [(float(k), float(k % 7), float(k * 37 % 2011) / 100, "p" if k < 5000 else "qr"[k // 1500 % 2]) for k in range(8000)]
    seen = []
    thinned, split = T._thinned, T._split_large
    try:
        T._thinned = lambda held, *a: seen.append("thin") or thinned(held, *a)
        T._split_large = lambda held, *a: seen.append(held.rows) or split(held, *a)
        model = T.fit(frame(spark, rows), COLS, "class", local_rows=1000)
    finally:
        T._thinned, T._split_large = thinned, split
    assert "thin" in seen and seen[-1] < seen[0] / 2
    one = T.fit(frame(spark, rows), COLS, "class")
    key = lambda m: sorted((r["node"], r["feature"], r["threshold"], tuple(r["counts"])) for r in T.node_table(m).collect())
    assert model.levels and not one.levels and key(model) == key(one)


def test_trees_go_in_waves_and_subtrees_are_copied_by_their_own_vectors(spark, monkeypatch):
    rows, asked = table(700, 8, values=60), table(500, 9, values=60)
    whole = T.fit(frame(spark, rows), COLS, "class", trees=4, tries=2, seed=5, local_rows=60)
    want = sorted(map(str, T.predict(whole, frame(spark, asked)).collect()))
    copies = []
    monkeypatch.setattr(T, "WAVE_ROWS", 500)
    waves = T._waves
    monkeypatch.setattr(T, "_waves", lambda n: [copies.append(w) or w for w in waves(n)])
    model = T.fit(frame(spark, rows), COLS, "class", trees=4, tries=2, seed=5, local_rows=60)
    assert len(copies) > 1 and [nested(model, t) for t in range(4)] == [nested(whole, t) for t in range(4)]
    copies.clear()
    assert sorted(map(str, T.predict(model, frame(spark, asked), slice_rows=50).collect())) == want and len(copies) > 1
