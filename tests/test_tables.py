"""Edge cases of the table operators on small hand-made frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import schemas as S
from skyloom.functions import expr as X
from skyloom.functions.text import image_object_id, visit_rank
from skyloom.operators import aggregates as A
from skyloom.operators import baskets as K
from skyloom.operators import binning as B
from skyloom.operators import cleaning as C
from skyloom.operators import design as D
from skyloom.operators import evaluation as E
from skyloom.operators import sampling as P
from skyloom.operators import scaling as Z
from skyloom.operators import selection as L
from skyloom.operators.ordering import exact_quantiles, ordered

NAN = float("nan")


def test_all_positive_rejects_zero_negative_nan_and_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, 2.0), (3, 1.0, -1.0), (4, NAN, 1.0), (5, None, 1.0)], "id int, a double, b double")
    assert [r.id for r in L.all_positive(df, ["a", "b"]).collect()] == [1]


def _sizes(spark, errors, mags=(20.0, 20.0, 20.0, 20.0, 1.0)):
    return spark.createDataFrame([(*mags, *[5.0] * 5, *errors)], ", ".join(f"{c} double" for c in S.BANDS + S.RADII + S.RADIUS_ERRORS))


@pytest.mark.parametrize("errors, kept, zeroed", [
    ((1.0, 1.0, 1.0, 1.0, 1.0), True, []),
    ((1.0, 1.0, 1.0, 1.0, -1.0), True, ["z"]),       # dim bad band
    ((-1.0, 1.0, 1.0, 1.0, 1.0), False, []),         # bright bad band
    ((-1.0, 1.0, 1.0, 1.0, -1.0), False, []),        # two bad bands, too bright
    ((-1.0, -1.0, 1.0, 1.0, -1.0), False, []),       # three bad bands
])
def test_repair_sizes(spark, errors, kept, zeroed):
    rows = C.repair_sizes(_sizes(spark, errors)).collect()
    assert len(rows) == (1 if kept else 0)
    for band in zeroed:
        assert rows[0][f"petroRad_{band}"] == 0.0 and rows[0][f"petroRadErr_{band}"] == 0.0


def test_two_dim_bad_bands_are_repaired(spark):
    rows = C.repair_sizes(_sizes(spark, (1.0, 1.0, 1.0, -1.0, -1.0), (50.0, 50.0, 50.0, 1.0, 1.0))).collect()
    assert rows[0].petroRad_i == 0.0 and rows[0].petroRad_z == 0.0 and rows[0].petroRad_u == 5.0


def test_bins_clamp_the_maximum_and_centre_constants(spark):
    df = spark.createDataFrame([(float(k), 7.0) for k in range(11)], "x double, c double")
    rows = B.bin_equal_width(df, ["x", "c"], 5).orderBy("x").collect()
    assert [r.x for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    assert {r.c for r in rows} == {3}


def test_histogram_takes_both_limits_and_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (1.0, 4.0), (3.0, 8.0), (9.0, 16.0)], "x double, w double")
    rows = {r.bin: r.total for r in B.histogram_sum(df, "x", "w", 0.0, 4.0, 4).collect()}
    assert rows == {1: 7.0, 2: 0.0, 3: 8.0, 4: 0.0}
    assert sum(rows.values()) == 15.0
    mean = {r.bin: r["mean"] for r in B.binned_weighted_mean(df, "x", "x", "w", 0.0, 4.0, 4).collect()}
    assert mean[1] == pytest.approx(5 / 6) and mean[2] is None and mean[3] == 3.0  # a mean leaves the lower limit out
    assert {r.bin: r.ratio for r in B.binned_ratio(df, "x", "w", "w", 0.0, 4.0, 4).collect()}[2] == 0.0


def test_thresholds_and_ties(spark):
    df = spark.createDataFrame([(29.9, 0.5), (30.0, 1.0), (59.0, 2.0), (60.0, NAN)], "i double, z double")
    assert [r[0] for r in df.select(X.inclination_level("i")).collect()] == ["low_i", "high_i", "med_i", "high_i"]
    assert [r[0] for r in df.select(X.distance_level("z")).collect()] == ["close", "far", "far", "far"]
    tie = spark.createDataFrame([(1.0, 3.0, 3.0)], "a double, b double, c double")
    assert tie.select(X.dominant(["a", "b", "c"])).first()[0] == "b"


def test_sample_baskets_carry_both_labels_if_untagged(spark):
    df = spark.createDataFrame([(False, False, 10.0, 1.0, 0.0, 0.0, 0.0)], "singlePeak boolean, doublePeak boolean, i double, f1 double, f2 double, f3 double, f4 double")
    assert K.baskets_samples(df).first()["items"] == ["singlePeak", "doublePeak", "low_i", "f1"]


def _brute_rules(baskets, support, confidence):
    from itertools import combinations
    n, counts = len(baskets), {}
    for b in baskets:
        items = sorted(set(b))
        for k in range(1, len(items) + 1):
            for c in combinations(items, k):
                counts[c] = counts.get(c, 0) + 1
    out = set()
    for items, c in counts.items():
        if len(items) < 2 or c < support * n:
            continue
        for y in items:
            x = tuple(i for i in items if i != y)
            if c / counts[x] >= confidence:
                out.add((",".join(x), y, c, round(c / n, 9), round(c / counts[x], 9), round(c / counts[x] / (counts[(y,)] / n), 9)))
    return out


def test_rules_match_brute_force_and_fp_growth(spark):
    rng = random.Random(3)
    baskets = [rng.sample("abcdefg", rng.randint(1, 5)) + ["a"] * rng.randint(0, 1) for _ in range(200)]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    want = _brute_rules(baskets, 0.1, 0.2)
    for found in (K.association_rules(df, 0.1, 0.2), K.association_rules_fp(df, 0.1, 0.2)):
        got = {(r.antecedent, r.consequent, r["count"], round(r.support, 9), round(r.confidence, 9), round(r.lift, 9)) for r in found.collect()}
        assert got == want


def test_long_baskets_have_exact_rules(spark):
    rng = random.Random(9)
    baskets = [[f"i{k:02d}" for k in range(40) if rng.random() < (0.9 if k < 4 else 0.3)] for _ in range(60)] + [[f"i{k:02d}" for k in range(40)], []]
    df = spark.createDataFrame([(b,) for b in baskets], "items array<string>")
    got = {(r.antecedent, r.consequent): r["count"] for r in K.association_rules(df, 0.3, 0.2).where("NOT antecedent LIKE '%,%'").collect()}
    names = sorted({x for b in baskets for x in b})
    want = {(x, y): n for x in names for y in names if x != y and (n := sum(x in b and y in b for b in baskets)) >= 0.3 * len(baskets)
            and n / sum(x in b for b in baskets) >= 0.2}
    assert got == want and max(map(len, baskets)) == 40


def test_recommendations_are_ordered_and_skip_purchases(spark):
    rules = spark.createDataFrame([(0, "tv", "bar"), (1, "tv", "game"), (2, "Xbox", "game")], "pos int, lhs string, rhs string")
    df = spark.createDataFrame([(1, "tv", "bar"), (2, "tv", None), (3, "tv", "tv"), (4, "xbox", "xbox")], "id int, search string, purchase string")
    got = {r.id: r.recommendations for r in K.recommend(df, rules).collect()}
    assert got == {1: ["tv", "game"], 2: ["tv", "bar", "game"], 3: ["bar", "game"], 4: []}


def test_credit(spark):
    df = spark.createDataFrame([(2,), (3,), (4,), (9,)], "score int")
    assert [r[0] for r in df.select(X.credit_line("score")).collect()] == [0, 0, 500, 3000]
    row = A.credit_summary(df).first()
    assert (row.approved_pct, row.mean_credit, row.total_credit) == (50.0, 875.0, 3500)


def test_visit_names(spark):
    names = ["a_b_c_d_x-e12_m", "a_b_c_d_x-e07_m", "a_b_c_d_x-e1A_m", "a_b_c_d_x-e1Z_m"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(visit_rank("n")).collect()] == [12, 7, 128, 153]
    files = spark.createDataFrame([("image_123456789012345678.jpeg",), ("readme.txt",)], "file string")
    assert [r[0] for r in files.select(image_object_id("file")).collect()] == [123456789012345678, None]


def test_ordered_agrees_with_python_over_many_cells(spark):
    rng = random.Random(1)
    data = [(s, rng.uniform(0, 50), rng.random()) for s in ("a", "b", None) for _ in range(200)]
    df = spark.createDataFrame(data, "s string, t double, y double").repartition(7)
    out = ordered(df, ["s"], "t", cell=3.0, previous=["y"], following=["t"], first=["y"], index="i", size="n").collect()
    assert len(out) == 600
    for s in ("a", "b", None):
        mine = sorted((r for r in data if r[0] == s), key=lambda r: r[1])
        got = sorted((r for r in out if r.s == s), key=lambda r: r.i)
        assert [r.i for r in got] == list(range(1, 201)) and {r.n for r in got} == {200}
        assert [r.t for r in got] == [m[1] for m in mine]
        assert [r.prev_y for r in got] == [None] + [m[2] for m in mine[:-1]]
        assert [r.next_t for r in got] == [m[1] for m in mine[1:]] + [None]
        assert {r.first_y for r in got} == {mine[0][2]}


def test_quantiles_are_exact_with_repeats_and_outliers(spark):
    rng = random.Random(2)
    data = [("hot", float(rng.choice([1, 1, 1, 2, 5]))) for _ in range(500)] + [("wide", rng.gauss(0, 1) ** 5) for _ in range(333)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {(r.g, r.fraction): r.quantile for r in exact_quantiles(df, ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0], accuracy=50).collect()}
    for g in ("hot", "wide", "one"):
        xs = sorted(x for k, x in data if k == g)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            p = q * (len(xs) - 1)
            lo, hi = xs[math.floor(p)], xs[math.ceil(p)]
            assert got[g, q] == pytest.approx(lo + (hi - lo) * (p - math.floor(p)))


def test_quantiles_of_small_groups_are_exact(spark):
    sizes = [*range(1, 41), 57, 100, 333, 502, 999, 1000, 1001, 1699, 2000]
    df = spark.createDataFrame([(n,) for n in sizes], "g int").select("g", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("x"))
    fractions = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.fraction): r.quantile for r in exact_quantiles(df, ["g"], "x", fractions).collect()}
    assert len(got) == len(sizes) * len(fractions)
    for n in sizes:
        for q in fractions:
            assert got[n, q] == pytest.approx(q * (n - 1)), (n, q)


def test_samples_and_splits(spark):
    df = spark.range(5000).withColumn("class", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    assert P.sample_n(df, 700, "id", 1).count() == 700
    ranked = df.withColumn("h", X.keyed_hash("id", 1)).orderBy("h", "id").limit(700)
    assert {r.id for r in P.sample_n(df, 700, "id", 1).collect()} == {r.id for r in ranked.collect()}
    assert P.sample_n(df, 5000, "id", 1).count() == P.sample_n(df, 9999, "id", 1).count() == 5000 and P.sample_n(df, 0, "id", 1).count() == 0
    drawn = P.sample_with_replacement(df, 5000, "id", 2, cell=500.0).collect()
    assert len(drawn) == 5000 and 2900 < len({r.id for r in drawn}) < 3400
    parts = P.split(df, "id", 0.3, 0.2, 5)
    sizes = {k: v.count() for k, v in parts.items()}
    assert sum(sizes.values()) == 5000 and abs(sizes["test"] - 1500) < 150 and abs(sizes["val"] - 700) < 120
    assert {r["class"]: r["count"] for r in P.sample_class(df, 20, "id").groupBy("class").count().collect()} == {"x": 20, "y": 20}


def test_streams_are_unrelated(spark):
    names = ["a/0", "a/1", 7, 8, "8/val"]
    x = np.array(spark.range(30000).select(*[X.uniform("id", n) for n in names], X.gaussian("id", 7)).collect())
    for i in range(len(names)):
        for j in range(len(names)):
            for lag in (0, 1, 7919, 12081) if i != j else (1, 7919):
                a, b = x[lag:, i], x[:len(x) - lag, j]
                assert abs(np.corrcoef(a, b)[0, 1]) < 5 / np.sqrt(len(a)) and not (a == b).any()
    assert abs(x[:, :5].mean() - 0.5) < 0.005 and abs(x[:, 5].mean()) < 0.03 and abs(x[:, 5].std() - 1) < 0.03
    cells = np.histogram2d(x[:, 2] < 0.3, x[:, 3] < 0.2, bins=2)[0]
    expected = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
    assert ((cells - expected) ** 2 / expected).sum() < 15


def test_hashes_reach_beyond_31_bits(spark):
    keys = spark.range(20000)
    row = keys.select(F.max(X.keyed_hash("id", 1)), F.count_distinct(X.keyed_hash("id", 1))).first()
    assert 2 ** 59 < row[0] < 2 ** 60 and row[1] == 20000
    far = spark.createDataFrame([(5,), (2 ** 31 + 4,), (2 ** 62,), (-5,), (None,)], "id long").select(X.uniform("id", 0)).collect()
    assert len({r[0] for r in far}) == 5 and all(0 < r[0] < 1 for r in far)


def test_scaling_of_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert [tuple(r) for r in Z.scale_minmax(df, ["a", "c"]).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in Z.scale_standard(df, ["a", "c"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_weights_ignore_repaired_bands(spark):
    df = spark.createDataFrame([(4.0, 0.0), (16.0, 2.0)], "v double, e double")
    rows = Z.observation_weights(df, ivars=["v"], errors=["e"]).orderBy("v").collect()
    assert [r.weight for r in rows] == [0.25, 1.0]


def test_grids(spark):
    grid = D.param_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).orderBy("grid_id").collect()
    assert [(r.a, r.b) for r in grid] == [(a, b) for a in (1, 2) for b in "xyz"]
    assert D.points_per_axis(1024, 10) == 2 and D.points_per_axis(1023, 10) == 1
    assert D.grid_design(spark, 1024).count() == 1024 and D.grid_design(spark, 500).count() == 500
    row = D.uniform_design(spark.range(1000), "id").agg(F.min("i"), F.max("i"), F.avg("i")).first()
    assert 0 < row[0] < 2 and 88 < row[1] < 90 and 42 < row[2] < 48


def test_confusion_matrix_has_empty_cells(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    cells = {(r.truth, r.predicted): r.n for r in E.confusion_matrix(df).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 1 and cells["c", "c"] == 0 and sum(cells.values()) == 4
    assert E.accuracy(df).first()[0] == 0.5


def test_best_rows_takes_the_first_on_ties_and_skips_nan(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, NAN), (4, 2.0)], "id int, e double")
    assert A.best_rows(df, ["e"], "id").first()["id"] == 1


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(float(k), float(k % 3)) for k in range(10)], "a double, b double")
    df.write.parquet(str(tmp_path / "in"))
    stream = L.all_positive(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["a", "b"])
    job = stream.writeStream.format("memory").queryName("positives").trigger(availableNow=True).start()
    job.awaitTermination(60)
    assert spark.table("positives").count() == L.all_positive(df, ["a", "b"]).count()
