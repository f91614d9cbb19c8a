"""Baskets, clusters, classifiers, regressions and their scores on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..operators import aggregates as A
from ..operators import baskets as K
from ..operators import binning as B
from ..operators import cleaning as C
from ..operators import clustering as G
from ..operators import design as D
from ..operators import evaluation as E
from ..operators import learning as M
from ..operators import neural as N
from ..operators import sampling as P
from ..operators import scaling as Z
from ..operators import selection as L
from ..operators import trees as T
from ..session import stored
from .bindings import SAMPLES_SQL, catalogue, samples, table, uniform_sql, with_sql
from .catalogue_queries import LINE_MEASURES, LINE_POSITIVE, MASKED, _W_TERMS, _dominant_sql, _weights_sql, bins_sql, CAT
from .registry import query, rounded

FEATURES = ["redshift", *S.SYNTHETIC_FLUXES, *S.BANDS]

# --- association rules ------------------------------------------------------

_SAMPLE_ITEMS = f"""SELECT list_concat(CASE WHEN "singlePeak" THEN ['singlePeak'] WHEN "doublePeak" THEN ['doublePeak']
    ELSE ['singlePeak', 'doublePeak'] END, [CASE WHEN i < 30 THEN 'low_i' WHEN i > 30 AND i < 60 THEN 'med_i' ELSE 'high_i' END,
    {_dominant_sql(S.SAMPLE_SHARES)}]) AS items FROM s"""
_CAT_ITEMS = f"""SELECT [{_dominant_sql(S.BANDS)}, {_dominant_sql(S.SYNTHETIC_FLUXES)}, class,
    CASE WHEN redshift < 1 THEN 'close' ELSE 'far' END, {_dominant_sql(S.RADII)}] AS items FROM cat"""
_ORDER_ITEMS = """SELECT ['status=' || o_orderstatus, 'priority=' || o_orderpriority, 'segment=' || c_mktsegment] AS items
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def _rules_sql(items: str, support: float, confidence: float, before: dict[str, str]) -> str:
    return with_sql({
        **before,
        "baskets": f"SELECT list_sort(list_distinct(items)) AS items, count(*) AS n FROM ({items}) GROUP BY 1",
        "total": "SELECT CAST(sum(n) AS BIGINT) AS t FROM baskets",
        "masks": "SELECT items, n, unnest(range(1, CAST(power(2, len(items)) AS BIGINT))) AS mask FROM baskets",
        "sets": "SELECT list_filter(items, lambda x, i: (mask >> CAST(i - 1 AS BIGINT)) & 1 = 1) AS items, CAST(sum(n) AS BIGINT) AS c FROM masks GROUP BY 1",
        "frequent": f"SELECT items, c FROM sets, total WHERE c >= t * {support}::DOUBLE",
        "wide": "SELECT items, c, unnest(items) AS consequent FROM frequent WHERE len(items) >= 2",
        "split": "SELECT list_filter(items, lambda x: x <> consequent) AS antecedent, consequent, c FROM wide",
    }, f"""SELECT array_to_string(antecedent, ',') AS antecedent, consequent, round(s.c / t, 9) AS support, round(s.c / a.c, 9) AS confidence,
    round(s.c / a.c / (b.c / t), 6) AS lift, s.c AS count FROM split s JOIN frequent a ON a.items = antecedent
    JOIN frequent b ON b.items = [consequent] CROSS JOIN total WHERE s.c / a.c >= {confidence}""")


def _tidy(rules: DataFrame) -> DataFrame:
    return rounded(rounded(rules, 9, ["support", "confidence"]), 6, ["lift"])


def _flat(df: DataFrame) -> DataFrame:
    items = F.array_join(F.sort_array(F.array_distinct("items")), ",")
    return df.groupBy(items.alias("basket")).agg(F.count(F.lit(1)).alias("n"))


def _flat_sql(items: str, before: dict[str, str]) -> str:
    return with_sql({**before, "x": items}, f"SELECT array_to_string(list_sort(list_distinct(items)), ',') AS basket, count(*) AS n FROM x GROUP BY 1")


def _order_baskets(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return K.baskets_from_columns(both.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
                                              F.col("c_mktsegment").alias("segment")), ["status", "priority", "segment"])


@query("arm1_sample_baskets", _flat_sql(_SAMPLE_ITEMS, {"s": SAMPLES_SQL}))
def _(spark, d):
    return _flat(K.baskets_samples(samples(spark, d)))


@query("arm2_catalogue_baskets", _flat_sql(_CAT_ITEMS, CAT))
def _(spark, d):
    return _flat(K.baskets_catalogue(catalogue(spark, d), size=True))


@query("arm3_column_baskets", _flat_sql(_ORDER_ITEMS, {}))
def _(spark, d):
    return _flat(_order_baskets(spark, d))


@query("arm4_rules_samples", _rules_sql(_SAMPLE_ITEMS, 0.1, 0.2, {"s": SAMPLES_SQL}))
def _(spark, d):
    return _tidy(K.association_rules(K.baskets_samples(samples(spark, d))))


@query("arm4_rules_catalogue", _rules_sql(_CAT_ITEMS, 0.1, 0.2, CAT))
def _(spark, d):
    return _tidy(K.association_rules(K.baskets_catalogue(catalogue(spark, d), size=True)))


@query("arm4_rules_columns", _rules_sql(_ORDER_ITEMS, 0.01, 0.2, {}))
def _(spark, d):
    return _tidy(K.association_rules(_order_baskets(spark, d), 0.01, 0.2))


@query("arm4_rules_fp_growth", _rules_sql(_CAT_ITEMS, 0.1, 0.2, CAT))
def _(spark, d):
    return _tidy(K.association_rules_fp(K.baskets_catalogue(catalogue(spark, d), size=True)))


_RULE_ROWS = [("1-URGENT", "HOUSEHOLD"), ("1-URGENT", "MACHINERY"), ("2-HIGH", "FURNITURE"), ("3-MEDIUM", "HOUSEHOLD"), ("5-LOW", "BUILDING")]
_RULES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(_RULE_ROWS)) + ") AS r(pos, lhs, rhs)"
_VISITS = "SELECT o_orderkey, o_orderpriority AS search, c_mktsegment AS purchase FROM orders JOIN customer ON o_custkey = c_custkey"


def _visits(spark, d):
    rules = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(_RULE_ROWS)], "pos int, lhs string, rhs string")
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", F.col("o_orderpriority").alias("search"), F.col("c_mktsegment").alias("purchase")), rules


@query("jn6_matching_rules", with_sql({"r": _RULES_SQL, "v": _VISITS}, """SELECT o_orderkey, rhs FROM v JOIN r ON lhs = search
    AND rhs IS DISTINCT FROM purchase"""))
def _(spark, d):
    return K.matching_rules(*_visits(spark, d)).select("o_orderkey", "rhs")


@query("arm5_recommend", with_sql({"r": _RULES_SQL, "v": _VISITS}, """SELECT o_orderkey, array_to_string(list_concat(
    CASE WHEN search IS DISTINCT FROM purchase THEN [search] ELSE [] END, coalesce(list(rhs ORDER BY pos)
    FILTER (rhs IS DISTINCT FROM purchase AND rhs IS NOT NULL), [])), ',') AS recommendations FROM v LEFT JOIN r ON lhs = search
    GROUP BY o_orderkey, search, purchase"""))
def _(spark, d):
    return K.recommend(*_visits(spark, d)).select("o_orderkey", F.array_join("recommendations", ",").alias("recommendations"))


# --- clusters ------------------------------------------------------------------

def _vectors(spark, d):
    emb = table(spark, d, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("class"),
                      *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(64)]), [f"x{k}" for k in range(64)]


# rows of three states, far apart: SQL knows the clusters
_FAR = "SELECT o_orderkey AS row_id, o_orderstatus AS class, o_custkey % 50 + CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 5000 ELSE 12000 END AS x FROM orders"


def _far(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_far")
    return spark.sql(_FAR.replace("FROM orders", "FROM orders_far"))


@query("clu1_kmeans", with_sql({"p": _FAR}, "SELECT count(*) AS n, round(avg(x), 4) AS centre FROM p GROUP BY class"))
def _(spark, d):
    assigned, centres, _ = G.kmeans(_far(spark, d), ["x"], 3, seed=7)
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.join(centres.withColumnRenamed("x", "centre"), "cluster").select("n", "centre"), 4)


@query("clu1_kmeans_vectors")
def _(spark, d):
    df, cols = _vectors(spark, d)
    assigned, _, _ = G.kmeans(df, cols, 4, seed=7)
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_SILHOUETTE = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    p AS (SELECT a.vec_id, a.label, b.label AS other, sum({measure}) AS s, count(*) AS n FROM e a, e b GROUP BY 1, 2, 3),
    w AS (SELECT vec_id, max(CASE WHEN label = other THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM p GROUP BY 1)
    SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM w"""


@query("clu2_silhouette", _SILHOUETTE.format(measure="list_distance(a.x, b.x)"))
def _(spark, d):
    df, cols = _vectors(spark, d)
    return rounded(G.silhouette(df.withColumn("cluster", F.col("class").cast("int")), cols, rows_per_block=512))


@query("clu2_silhouette_squared", _SILHOUETTE.format(measure="power(list_distance(a.x, b.x), 2)"))
def _(spark, d):
    df, cols = _vectors(spark, d)
    return rounded(G.silhouette(df.withColumn("cluster", F.col("class").cast("int")), cols, approx=True))


@query("clu3_select_k", with_sql({"p": _FAR, "g": "SELECT class, avg(x) AS m, avg(x * x) AS q, count(*) AS n FROM p GROUP BY 1",
       "w": """SELECT p.row_id, max(CASE WHEN p.class = g.class THEN (p.x * p.x - 2 * p.x * g.m + g.q) * g.n / (g.n - 1) END) AS a,
    min(CASE WHEN p.class <> g.class THEN p.x * p.x - 2 * p.x * g.m + g.q END) AS b FROM p CROSS JOIN g GROUP BY 1"""},
       "SELECT 3 AS k, round(avg((b - a) / greatest(a, b)), 6) AS score, true AS best FROM w"))
def _(spark, d):
    return rounded(G.select_k(_far(spark, d), ["x"], seed=7)[0].where("best"))


@query("clu3_select_k_vectors")
def _(spark, d):
    df, cols = _vectors(spark, d)
    return rounded(G.select_k(df, cols, seed=7, normalise=True)[0])


@query("clu4_attach_clusters", with_sql({"p": _FAR}, "SELECT class, class AS cluster_of, count(*) AS n FROM p GROUP BY 1"))
def _(spark, d):
    df = _far(spark, d)
    assigned, centres, _ = G.kmeans(df, ["x"], 3, seed=7)
    near = F.when(F.col("centre") < 2500, "F").when(F.col("centre") < 8500, "O").otherwise("P")
    both = L.attach_clusters(df.select("row_id", "class"), assigned.select("row_id", "cluster")).join(centres.withColumnRenamed("x", "centre"), "cluster")
    return both.groupBy("class", near.alias("cluster_of")).agg(F.count(F.lit(1)).alias("n"))


@query("clu4_attach_clusters_vectors")
def _(spark, d):
    df, cols = _vectors(spark, d)
    assigned, _, _ = G.kmeans(df, cols, 4, seed=7)
    return L.attach_clusters(df.select("row_id", "class"), assigned.select("row_id", "cluster"))


@query("clu5_cluster_class_lift", """WITH c AS (SELECT l_linenumber AS cluster, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT a.cluster, b.class, coalesce(n, 0) AS n, round((coalesce(n, 0) / cn - bn / t) / (bn / t), 9) AS lift
    FROM (SELECT cluster, sum(n) AS cn FROM c GROUP BY 1) a CROSS JOIN (SELECT class, sum(n) AS bn FROM c GROUP BY 1) b
    CROSS JOIN (SELECT sum(n) AS t FROM c) LEFT JOIN c ON c.cluster = a.cluster AND c.class = b.class""")
def _(spark, d):
    return rounded(G.cluster_class_lift(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag"), 9)


@query("clu6_cluster_means", " UNION ALL ".join(f"SELECT l_linenumber AS cluster, '{c}' AS feature, round(avg({c}), 4) AS centre FROM lineitem GROUP BY 1"
                                                 for c in LINE_MEASURES))
def _(spark, d):
    return rounded(G.cluster_means(table(spark, d, "lineitem"), LINE_MEASURES, "l_linenumber"), 4)


_Z = ("SELECT " + ", ".join(f"(l.{c} - m_{c}) / s_{c} AS {c}" for c in LINE_MEASURES) + " FROM lineitem l, (SELECT "
      + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in LINE_MEASURES) + " FROM lineitem)")


@query("clu7_feature_cosine", with_sql({"z": _Z}, " UNION ALL ".join(
    f'SELECT \'{a}\' AS "left", \'{b}\' AS "right", round(sum({a} * {b}) / sqrt(sum({a} * {a}) * sum({b} * {b})), 6) AS cosine FROM z'
    for i, a in enumerate(LINE_MEASURES) for b in LINE_MEASURES[i:])))
def _(spark, d):
    return rounded(G.feature_cosine(table(spark, d, "lineitem"), LINE_MEASURES))


@query("clu7_feature_dendrogram")
def _(spark, d):
    return rounded(G.feature_dendrogram(catalogue(spark, d), S.CLUSTER_WITH_SIZE))


# --- naive Bayes ------------------------------------------------------------------

def _bayes_sql(source: str, cols, label: str, key: str, seed: int, weight: str | None, body: str, before: dict[str, str]) -> str:
    w = weight or "1"
    sums = ", ".join(f"sum({w} * \"{c}\") AS s{k}" for k, c in enumerate(cols))
    mass = " + ".join(f"s{k}" for k in range(len(cols)))
    shares = ", ".join(f"ln((s{k} + 1) / (({mass}) + {len(cols)}))  AS p{k}" for k in range(len(cols)))
    score = "lp + (" + " + ".join(f"p{k} * t.\"{c}\"" for k, c in enumerate(cols)) + ")"
    return with_sql({
        **before,
        "binned": bins_sql(source, cols, 5),
        "marked": f"SELECT *, {uniform_sql(key, seed)} < 0.3 AS held, row_number() OVER () AS rid FROM binned",
        "sums": f'SELECT "{label}" AS label, sum({w})::DOUBLE AS w, {sums} FROM marked WHERE NOT held GROUP BY 1',
        "model": f"SELECT label, ln(w / (SELECT sum(w) FROM sums)) AS lp, {shares} FROM sums",
        "scored": f'''SELECT t.*, m.label AS prediction FROM marked t CROSS JOIN model m WHERE held
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {score} DESC, m.label) = 1''',
    }, body)


_LINE_KEY = "l_orderkey * 8 + l_linenumber"
_CONFUSION = """, c AS (SELECT {label} AS truth, prediction AS predicted, count(*) AS n FROM scored GROUP BY 1, 2),
    l AS (SELECT truth AS x FROM c UNION SELECT predicted FROM c) SELECT a.x AS truth, b.x AS predicted, coalesce(n, 0) AS n,
    round(coalesce(n, 0) / (SELECT max(n) FROM c), 9) AS share FROM l a CROSS JOIN l b LEFT JOIN c ON truth = a.x AND predicted = b.x"""


def _line_bayes(spark, d):
    masked = L.all_positive(table(spark, d, "lineitem"), LINE_MEASURES).select(
        *LINE_MEASURES, "l_returnflag", F.expr(_LINE_KEY).alias("key"))
    parts = P.split(B.bin_equal_width(masked, LINE_MEASURES, 5), "key", 0.3, seed=11)
    return M.naive_bayes(parts["train"], parts["test"], LINE_MEASURES, "l_returnflag")


@query("ml1_naive_bayes_confusion", _bayes_sql(
    f"(SELECT *, {_LINE_KEY} AS key FROM lineitem WHERE {LINE_POSITIVE})", LINE_MEASURES, "l_returnflag", "key", 11, None,
    "SELECT * FROM (WITH q AS (SELECT 1)" + _CONFUSION.format(label="l_returnflag") + ")", {}))
def _(spark, d):
    return rounded(E.confusion_matrix(_line_bayes(spark, d), "l_returnflag"), 9)


_WEIGHTED = {**MASKED, **_weights_sql("masked", _W_TERMS),
             "weighted": 'SELECT masked.*, raw / (SELECT max(raw) FROM raw) AS weight FROM masked JOIN raw USING ("specObjID")'}


def _catalogue_bayes(spark, d):
    cleaned = C.clean(catalogue(spark, d))[0]
    weighted = Z.observation_weights(cleaned)
    parts = P.split(B.bin_equal_width(weighted, FEATURES, 5), "specObjID", 0.3, seed=12)
    return M.naive_bayes(parts["train"], parts["test"], FEATURES, "class", "weight")


@query("ml1_naive_bayes_weighted", _bayes_sql("weighted", FEATURES, "class", '"specObjID"', 12, "weight",
       'SELECT class, prediction, count(*) AS n FROM scored GROUP BY 1, 2', _WEIGHTED))
def _(spark, d):
    return _catalogue_bayes(spark, d).groupBy("class", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("evl1_confusion_matrix", """WITH scored AS (SELECT o_orderpriority AS label, CASE WHEN o_custkey % 3 = 0 THEN '1-URGENT' ELSE o_orderpriority END
    AS prediction FROM orders)""" + _CONFUSION.format(label="label"))
def _(spark, d):
    guess = F.when(F.col("o_custkey") % 3 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return rounded(E.confusion_matrix(table(spark, d, "orders").withColumn("guess", guess), "o_orderpriority", "guess"), 9)


@query("evl2_weighted_accuracy", _bayes_sql("weighted", FEATURES, "class", '"specObjID"', 12, "weight",
       """SELECT round(sum(CASE WHEN class = prediction THEN weight ELSE 0 END) / sum(weight), 6) AS accuracy FROM scored""", _WEIGHTED))
def _(spark, d):
    return rounded(E.accuracy(_catalogue_bayes(spark, d), "class", weight="weight"))


@query("evl3_r2", """SELECT round(1 - sum(power(l_extendedprice - 2000 * l_quantity, 2)) / sum(power(l_extendedprice - m, 2)), 6) AS r2
    FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)""")
def _(spark, d):
    return rounded(E.r2(table(spark, d, "lineitem").withColumn("p", 2000 * F.col("l_quantity")), "l_extendedprice", "p"))


_MAE = """SELECT coalesce(l_returnflag, 'ALL') AS "group", count(*) AS n, round(avg(abs(l_extendedprice - 2000 * l_quantity)), 4) AS mae,
    round(avg(l_extendedprice), 4) AS mean_target{extra} FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())"""


@query("evl4_mae_by_class", _MAE.format(extra=""))
def _(spark, d):
    return rounded(E.mae_by_class(table(spark, d, "lineitem").withColumn("p", 2000 * F.col("l_quantity")), "l_extendedprice", "p", "l_returnflag"), 4)


@query("evl5_relative_error", _MAE.format(extra=", round(avg(abs(l_extendedprice - 2000 * l_quantity)) / avg(l_extendedprice), 6) AS relative_error"))
def _(spark, d):
    out = E.relative_error(table(spark, d, "lineitem").withColumn("p", 2000 * F.col("l_quantity")), "l_extendedprice", "p", "l_returnflag")
    return rounded(rounded(out, 4, ["mae", "mean_target"]), 6, ["relative_error"])


# --- fitted models -------------------------------------------------------------------
# Where a model must be exact, SQL knows what it predicts: three classes of order lines that lie apart in two of four features.

_APART = """SELECT l_orderkey * 8 + l_linenumber AS key, l_quantity + CASE WHEN l_quantity > 25 THEN 100 ELSE 0 END AS q,
    100 * l_discount + CASE WHEN l_discount > 0.05 THEN 10 ELSE 0 END AS disc, l_tax AS tax, CAST(l_linenumber AS DOUBLE) AS line,
    CASE WHEN l_quantity <= 25 THEN 'few' WHEN l_discount <= 0.05 THEN 'many' ELSE 'sale' END AS class FROM lineitem"""
_APART_COLS = ["q", "disc", "tax", "line"]
_APART_CONFUSION = with_sql({"x": _APART, "t": f"SELECT class, count(*) AS n FROM x WHERE {uniform_sql('key', 14)} < 0.3 GROUP BY 1"},
                            """SELECT a.class AS truth, b.class AS predicted, CASE WHEN a.class = b.class THEN a.n ELSE 0 END AS n,
    round(CASE WHEN a.class = b.class THEN a.n ELSE 0 END / (SELECT max(n) FROM t), 9) AS share FROM t a CROSS JOIN t b""")


def _apart(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_apart")
    return spark.sql(_APART.replace("FROM lineitem", "FROM lineitem_apart"))


def _apart_confusion(spark, d, fit):
    parts = P.split(_apart(spark, d), "key", 0.3, seed=14)
    return rounded(E.confusion_matrix(fit(parts["train"], parts["test"], _APART_COLS, "class"), "class"), 9)


def _parts(spark, d, seed=13, val=0.0):
    cleaned = L.all_positive(catalogue(spark, d)).select("specObjID", "class", *FEATURES, *S.RADII)
    return P.split(cleaned, "specObjID", 0.3, val, seed)


def _score(scored: DataFrame) -> DataFrame:
    return rounded(E.accuracy(scored, "class"), 4)


@query("ml2_logistic", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.logistic(*a)[1])


@query("ml2_logistic_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return _score(M.logistic(parts["train"], parts["test"], FEATURES, "class")[1])


@query("ml3_decision_tree", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.decision_tree(*a)[1])


@query("ml3_decision_tree_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return _score(M.decision_tree(parts["train"], parts["test"], FEATURES, "class")[1])


@query("ml4_tree_rules", with_sql({"x": _APART, "t": f"SELECT * FROM x WHERE {uniform_sql('key', 14)} >= 0.3"}, """
    SELECT 1 AS node, CAST(NULL AS INT) AS parent, 0 AS depth, 'q' AS feature, 75.5::DOUBLE AS threshold, mode(class) AS class FROM t
    UNION ALL SELECT 2, 1, 1, NULL, NULL, mode(class) FROM t WHERE q <= 75.5
    UNION ALL SELECT 3, 1, 1, 'disc', 10.5, mode(class) FROM t WHERE q > 75.5
    UNION ALL SELECT 6, 3, 2, NULL, NULL, mode(class) FROM t WHERE q > 75.5 AND disc <= 10.5
    UNION ALL SELECT 7, 3, 2, NULL, NULL, mode(class) FROM t WHERE q > 75.5 AND disc > 10.5"""))
def _(spark, d):
    parts = P.split(_apart(spark, d), "key", 0.3, seed=14)
    return rounded(M.tree_rules(T.fit(parts["train"], _APART_COLS, "class"), 3), 4)


@query("ml4_tree_rules_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return rounded(M.tree_rules(T.fit(parts["train"], FEATURES, "class"), 3), 4)


# Classes that overlap: the flags of order lines by four measures. A whole tree puts equal rows in one leaf, so SQL knows every
# prediction on its own rows; and the exact splits of the first levels are cumulative counts.

_FLAG_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LOCAL_ROWS = 40000  # above it Spark splits a node: from scale factor 0.01 on both ways of growing take part


def _split_sql(node: int) -> str:
    """Best (feature, threshold) of the rows in ``n{node}``, with the weights by class."""
    lists = " UNION ALL ".join(f"SELECT {k} AS f, {c} AS v, l_returnflag AS y FROM n{node}" for k, c in enumerate(_FLAG_COLS))
    flags = ("A", "N", "R")
    sums = ", ".join(f"count(*) FILTER (y = '{y}')::DOUBLE AS {y}" for y in flags)
    run = ", ".join(f"sum({y}) OVER (PARTITION BY f ORDER BY v) AS l{y}, sum({y}) OVER (PARTITION BY f) AS t{y}" for y in flags)

    def squares(names: list[str]) -> str:
        return f"({' + '.join(f'({n}) * ({n})' for n in names)}) / ({' + '.join(f'({n})' for n in names)})"

    score = squares([f"l{y}" for y in flags]) + " + " + squares([f"t{y} - l{y}" for y in flags])
    return f"""SELECT f, (v + next) / 2 AS t FROM (SELECT *, lead(v) OVER (PARTITION BY f ORDER BY v) AS next FROM
        (SELECT f, v, {run} FROM (SELECT f, v, {sums} FROM ({lists}) GROUP BY 1, 2))) WHERE next IS NOT NULL ORDER BY {score} DESC, f, t LIMIT 1"""


def _rules_of(nodes: list[int]) -> str:
    value = "CASE f " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(_FLAG_COLS)) + " END"
    ctes = {"n1": f"SELECT {', '.join(_FLAG_COLS)}, l_returnflag FROM lineitem"}
    for k in nodes:
        ctes[f"s{k}"] = _split_sql(k)
        ctes[f"n{2 * k}"] = f"SELECT n{k}.* FROM n{k}, s{k} WHERE {value} <= t"
        ctes[f"n{2 * k + 1}"] = f"SELECT n{k}.* FROM n{k}, s{k} WHERE {value} > t"
    names = "CASE f " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_FLAG_COLS)) + " END"
    rows = [f"""SELECT {k} AS node, {k // 2 if k > 1 else 'NULL'}::INTEGER AS parent, {k.bit_length() - 1} AS depth, (SELECT {names} FROM s{k}) AS feature,
        (SELECT round(t, 6) FROM s{k}) AS threshold, (SELECT count(*) FROM n{k})::DOUBLE AS n,
        (SELECT l_returnflag FROM n{k} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS class""" for k in nodes]
    return with_sql(ctes, " UNION ALL ".join(rows))


@query("ml4_tree_rules_lines", _rules_of([1, 2, 3, 4, 5, 6, 7]))
def _(spark, d):
    model = T.fit(table(spark, d, "lineitem").select(*_FLAG_COLS, "l_returnflag"), _FLAG_COLS, "l_returnflag", local_rows=_LOCAL_ROWS)
    mass = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b)
    return rounded(T.rules(model, 2).withColumn("n", mass).drop("counts"), 6)


@query("ml3_decision_tree_lines", f"""WITH v AS (SELECT {', '.join(_FLAG_COLS)}, l_returnflag AS truth, count(*) AS n FROM lineitem GROUP BY ALL),
    p AS (SELECT {', '.join(_FLAG_COLS)}, arg_min(truth, (-n, truth)) AS predicted FROM v GROUP BY ALL)
    SELECT truth, predicted, CAST(sum(n) AS BIGINT) AS n FROM v JOIN p USING ({', '.join(_FLAG_COLS)}) GROUP BY 1, 2""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(*_FLAG_COLS, "l_returnflag")
    scored = T.predict(T.fit(lines, _FLAG_COLS, "l_returnflag", local_rows=_LOCAL_ROWS), lines)
    return scored.groupBy(F.col("l_returnflag").alias("truth"), F.col("prediction").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("ml4_tree_size_lines", """SELECT l_returnflag AS class, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    """What the leaves of the whole tree hold: every row once."""
    model = T.fit(table(spark, d, "lineitem").select(*_FLAG_COLS, "l_returnflag"), _FLAG_COLS, "l_returnflag", local_rows=_LOCAL_ROWS)
    leaves = T.node_table(model).filter("feature IS NULL").select(F.posexplode("counts"))
    return leaves.groupBy(F.array(*[F.lit(x) for x in model.labels])[F.col("pos")].alias("class")).agg(F.sum("col").alias("n"))


@query("ml5_forest", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.random_forest(*a, seed=1)[1])


@query("ml5_forest_importances")
def _(spark, d):
    parts = _parts(spark, d)
    return rounded(M.random_forest(parts["train"], parts["test"], FEATURES, "class", seed=1)[2], 4)


# On classes that overlap: a zero gradient in the free intercepts means that probabilities add up to the class counts, and a duality gap
# below the limit proves that no weights have a smaller objective.

@query("ml2_calibration_lines", "SELECT l_returnflag AS class, count(*)::DOUBLE AS mass FROM lineitem GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(*_FLAG_COLS, "l_returnflag")
    model, scored = M.logistic(lines, lines, _FLAG_COLS, "l_returnflag")
    mass = scored.select(F.posexplode("probabilities")).groupBy("pos").agg(F.round(F.sum("col"), 4).alias("mass"))
    return mass.select(F.array(*[F.lit(x) for x in model.labels])[F.col("pos")].alias("class"), "mass")


_PAIRS = """WITH f AS (SELECT DISTINCT l_returnflag AS y FROM lineitem) SELECT a.y AS negative, b.y AS positive, true AS certified FROM f a JOIN f b ON a.y < b.y"""


def _certified(spark, d, kernel):
    lines = table(spark, d, "lineitem").select(*_FLAG_COLS, "l_returnflag")
    model, _ = M.svm(lines, lines, _FLAG_COLS, "l_returnflag", kernel)
    return M.certificates(model).select("negative", "positive", F.col("gap").between(0, 1e-3).alias("certified"))


@query("ml6_svm_certificates_lines", _PAIRS)
def _(spark, d):
    return _certified(spark, d, "linear")


@query("ml7_svm_certificates_lines", _PAIRS)
def _(spark, d):
    return _certified(spark, d, "poly")


@query("ml9_svr_certificate_lines", "SELECT count(*) AS n, true AS certified FROM lineitem")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    model, _ = M.linear_svr(lines, lines, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")
    return M.certificates(model).select(F.lit(model.rows).cast("long").alias("n"), F.col("gap").between(0, 1e-3).alias("certified"))


@query("ml6_svm_linear", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.svm(*a, "linear")[1])


@query("ml6_svm_linear_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return _score(M.svm(parts["train"], parts["test"], FEATURES, "class", "linear")[1])


@query("ml7_svm_poly", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.svm(*a, "poly")[1])


@query("ml7_svm_poly_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return _score(M.svm(parts["train"], parts["test"], FEATURES, "class", "poly")[1])


@query("ml8_svm_rbf", _APART_CONFUSION)
def _(spark, d):
    return _apart_confusion(spark, d, lambda *a: M.svm(*a, "rbf")[1])


@query("ml8_svm_rbf_catalogue")
def _(spark, d):
    parts = _parts(spark, d)
    return _score(M.svm(parts["train"], parts["test"], FEATURES, "class", "rbf")[1])


_LINEAR = "(3 * q - 2 * disc + 50 * tax + line)"


@query("ml9_linear_svr", with_sql({"x": _APART}, f"""SELECT class, count(*) AS n, round(avg({_LINEAR}), 2) AS mean, round(max({_LINEAR}), 2) AS top
    FROM x WHERE {uniform_sql('key', 14)} < 0.3 GROUP BY 1"""))
def _(spark, d):
    parts = P.split(_apart(spark, d).withColumn("y", F.expr(_LINEAR)), "key", 0.3, seed=14)
    _, scored = M.linear_svr(parts["train"], parts["test"], _APART_COLS, "y")
    return scored.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 2).alias("mean"), F.round(F.max("prediction"), 2).alias("top"))


@query("ml9_linear_svr_redshift")
def _(spark, d):
    parts = _parts(spark, d)
    _, scored = M.linear_svr(parts["train"], parts["test"], [*S.BANDS, *S.RADII], "redshift")
    return rounded(E.r2(scored, "redshift"), 4)


@query("ml10_mlp_regression")
def _(spark, d):
    parts = _parts(spark, d, val=0.2)
    _, scored, _ = N.mlp_regress(parts["train"], parts["test"], [*S.BANDS, *S.RADII], "redshift", val=parts["val"], weight_power=2, steps=2)
    return rounded(E.mae_by_class(scored, "redshift", "prediction", "class"), 4)


_GRID = [N.Setting(layers, width, power) for layers in (1, 2, 3, 4, 5) for width in (8, 16, 32, 64, 128, 256) for power in (0, 1, 2)]
_ERRORS = ["avg_err", "QSO_err", "GAL_err", "STAR_err"]
_SWEPT: dict[tuple[str, str], DataFrame] = {}


def _network_sweep(spark, d) -> DataFrame:
    """The 90 settings on the whole catalogue; written once per application, as the aggregates stand on the same table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _SWEPT:
        parts = _parts(spark, d, val=0.2)
        out = N.network_sweep(parts["train"], parts["test"], [*S.BANDS, *S.RADII], "redshift", "class",
                              {"QSO": "QSO_err", "GALAXY": "GAL_err", "STAR": "STAR_err"}, _GRID, epochs=25, steps=2, val=parts["val"])
        _SWEPT[key] = stored(out, "network-sweep")
    return _SWEPT[key]


@query("ml11_network_sweep")
def _(spark, d):
    return rounded(_network_sweep(spark, d), 6)


@query("agg3_network_marginals")
def _(spark, d):
    table = _network_sweep(spark, d)
    axes = [("nLayers", None), ("weightPow", None), ("nPerLayer", None), ("nLayers", F.col("weightPow") == 0), ("nPerLayer", F.col("weightPow") == 0)]
    parts = [A.sweep_marginals(table, axis, _ERRORS, where).select(F.lit(axis).alias("axis"), F.lit(where is not None).alias("unweighted"),
                                                                   F.col(axis).alias("value"), *_ERRORS) for axis, where in axes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return rounded(out, 6)


@query("agg4_network_best")
def _(spark, d):
    return rounded(A.best_rows(_network_sweep(spark, d).drop("history"), _ERRORS, "setting"), 6)


_COSTS = [0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0]


def _sweep(spark, d, grid, schema, together=False):
    """Settings x three data sets: model samples by peak kind, and the catalogue with and without sizes."""
    parts = _parts(spark, d)
    peaks = samples(spark, d).withColumn("class", F.when(F.col("singlePeak"), "single").when(F.col("doublePeak"), "double").otherwise("none"))
    own = P.split(peaks, "row_id", 0.3, seed=13)
    frames = [f.persist() for f in (parts["train"], parts["test"], own["train"], own["test"])]
    shape = [*S.SAMPLE_SHARES, "i", "phaseAmplitude", "t_char", "rBLR", "FHWM"]

    def fit(data, **point):
        train, test, cols = data
        return E.accuracy(M.svm(train, test, cols, "class", **{"kernel": "rbf", **point})[1], "class").first()[0]

    def fit_costs(data, points):
        train, test, cols = data
        scored = stored(M.svm_costs(train, test, cols, "class", [p["C"] for p in points])[1].select("class", "predictions"), "sweep-scored")
        return [E.accuracy(scored.withColumn("prediction", F.get("predictions", F.lit(k))), "class").first()[0] for k in range(len(points))]

    try:
        sets = {"samples": (frames[2], frames[3], shape), "wSize": (frames[0], frames[1], [*FEATURES, *S.RADII]), "noSize": (frames[0], frames[1], FEATURES)}
        out = M.sweep(fit_costs if together else fit, grid, sets, schema, together=together)
    finally:
        for f in frames:
            f.unpersist()
    return rounded(out, 4, ["score"])


@query("ml11_sweep")
def _(spark, d):
    return _sweep(spark, d, [{"C": c} for c in _COSTS], "file string, C double, score double", together=True)


@query("ml11_kernel_sweep")
def _(spark, d):
    return _sweep(spark, d, [{"kernel": k} for k in ("rbf", "linear", "poly")], "file string, kernel string, score double")


@query("ml11_sweep_apart", "SELECT 'lines' AS file, unnest([0.1::DOUBLE, 0.5, 1, 2, 3, 4, 5]) AS \"C\", count(*) AS n, CAST(sum(CASE WHEN class = 'few' THEN 1 ELSE 0 END) AS BIGINT) AS few "
       f"FROM ({_APART}) WHERE {uniform_sql('key', 14)} < 0.3")
def _(spark, d):
    parts = P.split(_apart(spark, d), "key", 0.3, seed=14)

    def fit(data, points):
        scored = M.svm_costs(*data, _APART_COLS, "class", [p["C"] for p in points], "linear")[1]
        row = scored.agg(*[F.count_if(right & more).alias(f"{name}{k}") for k in range(len(points)) for right in [F.col("class") == F.get("predictions", F.lit(k))]
                           for name, more in (("n", F.lit(True)), ("few", F.col("class") == "few"))]).first()
        return [{"n": row[f"n{k}"], "few": row[f"few{k}"]} for k in range(len(points))]

    return M.sweep(fit, [{"C": c} for c in _COSTS], {"lines": (parts["train"], parts["test"])}, "file string, C double, n long, few long", together=True)


# --- a sweep whose scores SQL knows: the error of "price is C thousand times the quantity" on the lines of each flag

_PRICE_SWEEP = """(SELECT l_returnflag AS file, CAST(c AS DOUBLE) AS "C", avg(abs(l_extendedprice - 1000 * c * l_quantity)) AS score,
    avg(abs(l_extendedprice - 1000 * c * l_quantity) / l_extendedprice) AS share FROM lineitem CROSS JOIN unnest([1, 2, 3, 4, 5, 6, 7]) AS u(c) GROUP BY 1, 2)"""


def _price_sweep(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem")
    flags = [r[0] for r in lines.select("l_returnflag").distinct().collect()]  # the data sets of the sweep

    def fit(data, C):
        miss = F.abs(F.col("l_extendedprice") - 1000 * C * F.col("l_quantity"))
        return data.agg(F.avg(miss).alias("score"), F.avg(miss / F.col("l_extendedprice")).alias("share")).first().asDict()

    return M.sweep(fit, [{"C": float(c)} for c in range(1, 8)], {f: lines.filter(F.col("l_returnflag") == f) for f in flags},
                   "file string, C double, score double, share double")


@query("set3_sweep_table", f"""SELECT file, "C", round(score, 4) AS score, round(share, 8) AS share FROM {_PRICE_SWEEP}""")
def _(spark, d):
    return rounded(rounded(_price_sweep(spark, d), 4, ["score"]), 8, ["share"])


@query("agg3_sweep_table", f"""SELECT "C", round(avg(score), 4) AS score, round(avg(share), 8) AS share FROM {_PRICE_SWEEP} WHERE file <> 'N' GROUP BY 1""")
def _(spark, d):
    out = A.sweep_marginals(_price_sweep(spark, d), "C", ["score", "share"], F.col("file") != "N")
    return rounded(rounded(out, 4, ["score"]), 8, ["share"])


@query("agg4_sweep_table", " UNION ALL ".join(f"""SELECT * FROM (SELECT '{m}' AS measure, file, "C", round(score, 4) AS score, round(share, 8) AS share
    FROM {_PRICE_SWEEP} ORDER BY {m}, file LIMIT 1)""" for m in ("score", "share")))
def _(spark, d):
    return rounded(rounded(A.best_rows(_price_sweep(spark, d), ["score", "share"], "file"), 4, ["score"]), 8, ["share"])
