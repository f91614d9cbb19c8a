"""Filters, projections, joins, sets, samples, cleaning, bins, scaling and weights on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import expr as X
from ..functions.text import last_token, visit_rank
from ..operators import aggregates as A
from ..operators import binning as B
from ..operators import cleaning as C
from ..operators import design as D
from ..operators import sampling as P
from ..operators import scaling as Z
from ..operators import selection as L
from ..operators.ordering import attach, ordered
from .bindings import (
    CATALOGUE_SQL, MASKED_SQL, MICROS_SQL, RAYS_SQL, SAMPLES_SQL, CURVES_SQL, catalogue, curves, keyed_hash_sql, rays,
    samples, table, uniform_sql, with_micros, with_sql,
)
from .registry import query, rounded

CAT = {"cat": CATALOGUE_SQL}
MASKED = {**CAT, "masked": MASKED_SQL}
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_POSITIVE = " AND ".join(f"{c} > 0" for c in LINE_MEASURES)


def _q(names, prefix=""):
    return ", ".join(f'{prefix}"{n}"' for n in names)


# --- selection -----------------------------------------------------------

_SELECTED = {"order_id": "o_orderkey", "class": "o_orderstatus", "redshift": "o_totalprice", "customer": "c_custkey",
             "balance": "c_acctbal", "segment": "c_mktsegment"}


def _selected(spark, d, n=None):
    return L.select_catalogue(table(spark, d, "customer"), table(spark, d, "orders"), "F", n, photo_key="c_custkey",
                              spec_key="o_custkey", class_col="o_orderstatus", warning_col=None, columns=_SELECTED,
                              order_by="order_id")


_SELECT_SQL = ("SELECT o_orderkey AS order_id, o_orderstatus AS class, o_totalprice AS redshift, c_custkey AS customer, "
               "c_acctbal AS balance, c_mktsegment AS segment FROM customer JOIN orders ON o_custkey = c_custkey "
               "WHERE o_orderstatus = 'F'")


@query("flt1_select_class", with_sql(CAT, """SELECT "specObjID", class, redshift, u, g, r, i, z FROM cat
    WHERE class = 'QSO' AND plate % 5 <> 0"""))
def _(spark, d):
    cat = catalogue(spark, d).withColumn("zWarning", (F.col("plate") % 5 == 0).cast("int"))
    return cat.where((F.col("class") == "QSO") & (F.col("zWarning") == 0)).select("specObjID", "class", "redshift", *S.BANDS)


@query("prj1_select_renamed", _SELECT_SQL)
def _(spark, d):
    return _selected(spark, d)


@query("jn1_photometry_spectroscopy", """SELECT o_orderstatus AS class, l_returnflag AS flag, count(*) AS n,
    round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderstatus = 'O' GROUP BY 1, 2""")
def _(spark, d):
    joined = L.select_catalogue(table(spark, d, "lineitem"), table(spark, d, "orders"), "O", photo_key="l_orderkey",
                                spec_key="o_orderkey", class_col="o_orderstatus", warning_col=None)
    return joined.groupBy(F.col("o_orderstatus").alias("class"), F.col("l_returnflag").alias("flag")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("srt1_top_n", _SELECT_SQL + " ORDER BY order_id LIMIT 1000")
def _(spark, d):
    return _selected(spark, d, 1000)


@query("flt2_all_positive", f"SELECT l_orderkey, l_partkey, {', '.join(LINE_MEASURES)} FROM lineitem WHERE {LINE_POSITIVE}")
def _(spark, d):
    return L.all_positive(table(spark, d, "lineitem"), LINE_MEASURES).select("l_orderkey", "l_partkey", *LINE_MEASURES)


@query("flt3_label", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def _(spark, d):
    return L.with_label(table(spark, d, "events"), "event_type", "purchase").select("event_id", "user_id", "value")


@query("flt4_open_range", f"""SELECT event_id, us FROM ({MICROS_SQL}) WHERE us > 86400000000 AND us <= 864000000000""")
def _(spark, d):
    ev = with_micros(table(spark, d, "events"))
    return L.clip_range(ev, "us", 86400000000, 864000000000, "right").select("event_id", "us")


@query("prj2_drop_features", with_sql(CAT, f"SELECT * EXCLUDE ({_q(S.BOOKKEEPING + S.RADIUS_ERRORS)}, redshift) FROM cat"))
def _(spark, d):
    return L.drop_features(catalogue(spark, d), "wSize", ["redshift"])


@query("prj3_cluster_features", with_sql(CAT, f'SELECT "specObjID", {_q(S.CLUSTER_WITH_SIZE)} FROM cat'))
def _(spark, d):
    return L.cluster_features(catalogue(spark, d), "wSize", ["specObjID"])


@query("prj4_peak_label", with_sql({"s": SAMPLES_SQL}, """SELECT CASE WHEN "singlePeak" THEN 'singlePeak' ELSE 'doublePeak' END
    AS label, count(*) AS n FROM s GROUP BY 1"""))
def _(spark, d):
    return A.count_by(L.peak_label(samples(spark, d)), "label")


_SHARE = "f1 + f2 + f3 + f4"


@query("prj5_normalise_shares", with_sql({"s": SAMPLES_SQL}, f"""SELECT row_id, {', '.join(
    f"round({f} / nullif({_SHARE}, 0), 9) AS {f}" for f in S.SAMPLE_SHARES)} FROM s"""))
def _(spark, d):
    return rounded(L.normalise_shares(samples(spark, d)).select("row_id", *S.SAMPLE_SHARES), 9)


_UNPIVOT = " UNION ALL ".join(
    f"SELECT o_orderkey AS t, '{n}' AS series_id, f{k} AS flux, e{k} AS error FROM w" for k, n in enumerate(S.CURVE_NAMES))
_WIDE = "SELECT o_orderkey, " + ", ".join(
    f"o_totalprice * {k + 1} AS f{k}, CAST(o_custkey AS DOUBLE) / {k + 1} AS e{k}" for k in range(len(S.CURVE_NAMES))) + " FROM orders"


@query("prj6_named_series", with_sql({"w": _WIDE}, f"SELECT * FROM ({_UNPIVOT}) WHERE series_id IN ('1367', 'CIV')"))
def _(spark, d):
    orders = table(spark, d, "orders")
    wide = orders.select(F.col("o_orderkey").alias("t"), *[c for k, n in enumerate(S.CURVE_NAMES) for c in (
        (F.col("o_totalprice") * (k + 1)).alias(S.flux_column(n)),
        (F.col("o_custkey").cast("double") / (k + 1)).alias("e_" + S.flux_column(n)))])
    return L.unpivot_curves(wide, ["1367", "CIV"])


@query("prj7_model_flux", """SELECT o_orderkey, round(o_totalprice / 1 + o_totalprice / 3 + o_totalprice / 4, 4) AS model_flux
    FROM orders""")
def _(spark, d):
    wide = table(spark, d, "orders").select("o_orderkey", *[(F.col("o_totalprice") / j).alias(f"GAUSS{j}") for j in (1, 2, 3, 4)])
    return rounded(L.model_flux(wide, [1, 3, 4]).select("o_orderkey", "model_flux"), 4)


# --- joins ---------------------------------------------------------------

@query("jn2_objects_with_images", """SELECT o_orderkey AS "specObjID", o_orderstatus AS class FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(spark, d):
    files = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.format_string("image_%d.jpeg", "l_orderkey").alias("file"))
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("specObjID"), F.col("o_orderstatus").alias("class"))
    return L.objects_with_images(objects, files)


_W_TERMS = [f'sqrt("{c}")' for c in S.IVARS] + [f'1 / nullif("{c}", 0)' for c in S.MAGNITUDE_ERRORS]


def _weights_sql(source: str, terms: list[str]) -> dict[str, str]:
    named = ", ".join(f"{t} AS w{k}" for k, t in enumerate(terms))
    tops = ", ".join(f"max(w{k}) AS x{k}" for k in range(len(terms)))
    total = " + ".join(f"coalesce(w{k} / x{k}, 0)" for k in range(len(terms)))
    return {"terms": f'SELECT "specObjID", class, {named} FROM {source}', "tops": f"SELECT {tops} FROM terms",
            "raw": f'SELECT "specObjID", class, {total} AS raw FROM terms, tops'}


@query("jn3_attach_weights", with_sql({**MASKED, **_weights_sql("masked", _W_TERMS)}, f"""SELECT class, count(*) AS n,
    round(sum(raw / (SELECT max(raw) FROM raw)), 6) AS weight FROM raw
    WHERE {uniform_sql('"specObjID"', 3)} >= 0.3 GROUP BY 1"""))
def _(spark, d):
    masked = L.all_positive(catalogue(spark, d))
    weights = Z.observation_weights(masked).select("specObjID", "weight")
    train = P.split(masked.select("specObjID", "class"), "specObjID", 0.3, seed=3)["train"]
    return L.attach_weights(train, weights, "specObjID").groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query("jn4_attach_clusters", """SELECT o_orderkey % 4 AS cluster, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("class"))
    assigned = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_orderkey") % 4).alias("cluster"))
    return L.attach_clusters(rows, assigned).groupBy("cluster", "class").agg(F.count(F.lit(1)).alias("n"))


@query("jn9_interval_bins", with_sql({"r": RAYS_SQL}, """SELECT CAST(ceil(x / (CAST(1 AS DOUBLE) / 20)) AS INT) AS bin, count(*) AS n FROM r
    WHERE x > 0 AND x <= 1 GROUP BY 1"""))
def _(spark, d):
    return rays(spark, d).withColumn("bin", B.range_bin("x", 0.0, 1.0, 20)).where("bin IS NOT NULL").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))


# --- aggregates ----------------------------------------------------------

@query("agg1_count_by", "SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def _(spark, d):
    return A.count_by(table(spark, d, "lineitem"), "l_linenumber")


@query("agg2_credit_summary", """SELECT round(100 * avg(CASE WHEN a > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS approved_pct,
    round(avg(a), 6) AS mean_credit, CAST(sum(a) AS BIGINT) AS total_credit
    FROM (SELECT greatest(0, 500 * l_linenumber - 1500) AS a FROM lineitem)""")
def _(spark, d):
    return rounded(A.credit_summary(table(spark, d, "lineitem"), "l_linenumber"))


@query("agg3_sweep_marginals", """SELECT l_linenumber, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax,
    round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1""")
def _(spark, d):
    out = A.sweep_marginals(table(spark, d, "lineitem"), "l_linenumber", ["l_discount", "l_tax", "l_extendedprice"],
                            F.col("l_linestatus") == "O")
    return rounded(rounded(out, 6, ["l_discount", "l_tax"]), 4, ["l_extendedprice"])


@query("agg4_best_rows", with_sql(CAT, " UNION ALL ".join(f"""SELECT * FROM (SELECT '{m}' AS measure, "specObjID", class, u, g, redshift
    FROM cat ORDER BY {m}, "specObjID" LIMIT 1)""" for m in ("u", "g", "redshift"))))
def _(spark, d):
    return A.best_rows(catalogue(spark, d).select("specObjID", "class", "u", "g", "redshift"), ["u", "g", "redshift"], "specObjID")


@query("agg5_bad_bands", with_sql(CAT, f"""SELECT n_bad, count(*) AS n FROM (SELECT {' + '.join(
    f'CAST("{e}" < 0 AS INT)' for e in S.RADIUS_ERRORS)} AS n_bad FROM cat) GROUP BY 1"""))
def _(spark, d):
    return C.bad_bands(catalogue(spark, d)).groupBy("n_bad").agg(F.count(F.lit(1)).alias("n"))


@query("agg6_column_range", "SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in LINE_MEASURES) + " FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").agg(*[x for c in LINE_MEASURES for x in (F.min(c).alias("lo_" + c), F.max(c).alias("hi_" + c))])


@query("agg7_weighted_mean", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6)
    AS weighted_mean FROM lineitem GROUP BY 1, 2""")
def _(spark, d):
    return rounded(A.weighted_mean(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linestatus"]))


@query("agg8_box_summary", " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS measure, round(min({c}), 6) AS lowest,
    round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3,
    round(max({c}), 6) AS highest FROM lineitem GROUP BY 1""" for c in LINE_MEASURES))
def _(spark, d):
    return rounded(A.box_summary(table(spark, d, "lineitem"), LINE_MEASURES, "l_returnflag"))


@query("agg10_sum_over", with_sql({"r": RAYS_SQL}, """SELECT model_id, round(sum(phase_weight), 4) AS total FROM r GROUP BY 1"""))
def _(spark, d):
    return rounded(A.sum_over(rays(spark, d), "phase_weight", ["model_id"]), 4)


@query("agg11_pivot_scores", """SELECT l_linenumber, round(max(CASE WHEN l_returnflag = 'A' THEN s END), 6) AS "A",
    round(max(CASE WHEN l_returnflag = 'N' THEN s END), 6) AS "N", round(max(CASE WHEN l_returnflag = 'R' THEN s END), 6) AS "R"
    FROM (SELECT l_linenumber, l_returnflag, 100 * avg(l_discount) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def _(spark, d):
    scores = A.sweep_marginals(table(spark, d, "lineitem").withColumn("key", F.struct("l_linenumber", "l_returnflag")), "key", ["l_discount"])
    flat = scores.select("key.*", F.col("l_discount").alias("score"))
    return rounded(A.pivot_scores(flat, "l_linenumber", "l_returnflag"))


# --- windows -------------------------------------------------------------

@query("win1_rebase", with_sql({"k": CURVES_SQL}, """SELECT series_id, round(t - first_value(t) OVER w, 9) AS t,
    round(flux - first_value(flux) OVER w, 6) AS flux FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t)"""))
def _(spark, d):
    out = ordered(curves(spark, d), ["series_id"], "t", first=["t", "flux"])
    return out.select("series_id", F.round(F.col("t") - F.col("first_t"), 9).alias("t"),
                      F.round(F.col("flux") - F.col("first_flux"), 6).alias("flux"))


@query("win2_forward_step", with_sql({"k": CURVES_SQL}, """SELECT series_id, round(t, 9) AS t,
    round(coalesce(lead(t) OVER w - t, t - lag(t) OVER w), 9) AS step FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t)"""))
def _(spark, d):
    out = ordered(curves(spark, d), ["series_id"], "t", previous=["t"], following=["t"])
    return out.select("series_id", F.round("t", 9).alias("t"),
                      F.round(F.coalesce(F.col("next_t") - F.col("t"), F.col("t") - F.col("prev_t")), 9).alias("step"))


@query("win3_adjacent_trapezoids", with_sql({"k": CURVES_SQL}, """SELECT series_id, round(sum(a), 6) AS area FROM (SELECT series_id,
    (t - lag(t) OVER w) * (flux + lag(flux) OVER w) / 2 AS a FROM k WINDOW w AS (PARTITION BY series_id ORDER BY t)) GROUP BY 1"""))
def _(spark, d):
    out = ordered(curves(spark, d), ["series_id"], "t", previous=["t", "flux"])
    area = (F.col("t") - F.col("prev_t")) * (F.col("flux") + F.col("prev_flux")) / 2
    return out.groupBy("series_id").agg(F.round(F.sum(area), 6).alias("area"))


@query("win4_first_last_position", with_sql({"k": CURVES_SQL}, """SELECT series_id, round(min(CASE WHEN flux > 60 THEN t END), 9) AS first_t,
    round(max(CASE WHEN flux > 60 THEN t END), 9) AS last_t, round(arg_max(t, (flux, -t)), 9) AS peak_t FROM k GROUP BY 1"""))
def _(spark, d):
    high = F.when(F.col("flux") > 60, F.col("t"))
    return curves(spark, d).groupBy("series_id").agg(
        F.round(F.min(high), 9).alias("first_t"), F.round(F.max(high), 9).alias("last_t"),
        F.round(F.max_by("t", F.struct("flux", -F.col("t"))), 9).alias("peak_t"))


@query("win5_series_span", with_sql({"k": CURVES_SQL}, """SELECT series_id, round(t, 9) AS t, round(flux / max(flux) OVER w, 9) AS relative,
    round((flux - min(flux) OVER w) / (max(flux) OVER w - min(flux) OVER w), 9) AS spanned FROM k WINDOW w AS (PARTITION BY series_id)"""))
def _(spark, d):
    out = attach(curves(spark, d), ["series_id"], hi=F.max("flux"), lo=F.min("flux"))
    return rounded(out.select("series_id", "t", (F.col("flux") / F.col("hi")).alias("relative"),
                              ((F.col("flux") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("spanned")), 9)


@query("win6_scale_by_max", """SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 9) AS o_totalprice FROM orders""")
def _(spark, d):
    return rounded(Z.scale_by_max(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 9)


# --- sorts, samples, sets ------------------------------------------------


@query("srt2_visit_order", f"""SELECT page_id, CASE WHEN p[3] IN ('0','1','2','3','4','5','6','7','8','9') THEN CAST(p[2:] AS INT)
    ELSE 27 * CAST(p[2] AS INT) + ascii(p[-1:]) - 65 + 101 END AS rank FROM (SELECT page_id,
    CASE WHEN page_id % 3 = 0 THEN 'e' || (page_id % 10) || chr(CAST(65 + page_id % 7 AS INT)) ELSE 'e' || (10 + page_id % 90) END AS p FROM pages)""")
def _(spark, d):
    piece = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("e"), F.col("page_id") % 10, F.char(65 + F.col("page_id") % 7))) \
             .otherwise(F.concat(F.lit("e"), 10 + F.col("page_id") % 90))
    names = table(spark, d, "pages").select("page_id", F.concat(F.lit("in_st_cos_ob_v-"), piece, F.lit("_model.fits")).alias("file"))
    return names.select("page_id", visit_rank("file").alias("rank")).orderBy("rank")


@query("smp1_fraction", f"SELECT o_orderkey FROM orders WHERE {uniform_sql('o_orderkey', 5)} < 0.1")
def _(spark, d):
    return P.sample_fraction(table(spark, d, "orders"), 0.1, "o_orderkey", 5).select("o_orderkey")


@query("smp2_exact_n", f"SELECT o_orderkey FROM orders ORDER BY {keyed_hash_sql('o_orderkey', 6)}, o_orderkey LIMIT 500")
def _(spark, d):
    return P.sample_n(table(spark, d, "orders").select("o_orderkey"), 500, "o_orderkey", 6)


@query("smp3_with_replacement", f"""SELECT CAST(draw AS BIGINT) AS draw, o_orderkey FROM (SELECT range AS draw, CAST(floor({uniform_sql('range', 7)}
    * (SELECT count(*) FROM orders)) AS BIGINT) + 1 AS pick FROM range(1000)) JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey)
    AS idx FROM orders) ON pick = idx""")
def _(spark, d):
    return P.sample_with_replacement(table(spark, d, "orders").select("o_orderkey"), 1000, "o_orderkey", 7, cell=4096)


@query("smp4_per_class", f"""SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY {keyed_hash_sql('o_orderkey', 8)}, o_orderkey) <= 50""")
def _(spark, d):
    return P.sample_class(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), 50, "o_orderkey", "o_orderstatus", seed=8)


@query("smp5_split", f"""SELECT o_orderkey, CASE WHEN {uniform_sql('o_orderkey', 1)} < 0.3 THEN 'test'
    WHEN {uniform_sql('o_orderkey', '1/val')} < 0.2 THEN 'val' ELSE 'train' END AS split FROM orders""")
def _(spark, d):
    return P.with_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.3, 0.2, 1)


@query("set1_union_all", """SELECT c_custkey AS id, c_nationkey AS nation, 'customer' AS class FROM customer UNION ALL
    SELECT s_suppkey, s_nationkey, 'supplier' FROM supplier""")
def _(spark, d):
    return L.combine({"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")),
                      "supplier": table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))})


@query("set4_distinct_labels", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def _(spark, d):
    return L.distinct_labels(table(spark, d, "orders"), "o_orderpriority")


# --- scalar functions ----------------------------------------------------

@query("scl1_math", """SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(1000000 / o_totalprice, 6) AS inverse,
    round(power(o_totalprice / 1000, 2), 4) AS square, round(abs(o_totalprice - 200000), 2) AS distance,
    greatest(0, o_custkey - 500) AS above, round(log10(o_totalprice), 9) AS lg, CAST(floor(o_totalprice / 1000) AS BIGINT) AS down,
    CAST(ceil(o_totalprice / 1000) AS BIGINT) AS up FROM orders""")
def _(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", F.round(F.sqrt(p), 6).alias("root"), F.round(1000000 / p, 6).alias("inverse"),
        F.round(F.pow(p / 1000, F.lit(2.0)), 4).alias("square"), F.round(F.abs(p - 200000), 2).alias("distance"),
        F.greatest(F.lit(0).cast("long"), F.col("o_custkey") - 500).alias("above"), F.round(F.log10(p), 9).alias("lg"),
        F.floor(p / 1000).alias("down"), F.ceil(p / 1000).alias("up"))


def _dominant_sql(cols):
    greatest = ", ".join(f'"{c}"' for c in cols)
    return "CASE " + " ".join(f"WHEN \"{c}\" = greatest({greatest}) THEN '{c}'" for c in cols) + " END"


@query("scl2_dominant", with_sql(CAT, f"""SELECT {_dominant_sql(S.BANDS)} AS mag, {_dominant_sql(S.SYNTHETIC_FLUXES)} AS flux, count(*) AS n
    FROM cat GROUP BY 1, 2"""))
def _(spark, d):
    return catalogue(spark, d).select(X.dominant(S.BANDS).alias("mag"), X.dominant(S.SYNTHETIC_FLUXES).alias("flux")) \
        .groupBy("mag", "flux").agg(F.count(F.lit(1)).alias("n"))


@query("scl3_thresholds", with_sql({"s": SAMPLES_SQL, **CAT}, """SELECT CASE WHEN i < 30 THEN 'low_i' WHEN i > 30 AND i < 60 THEN 'med_i'
    ELSE 'high_i' END AS level, CASE WHEN redshift < 1 THEN 'close' ELSE 'far' END AS distance, count(*) AS n FROM (SELECT row_id, i FROM s)
    JOIN (SELECT "specObjID", redshift FROM cat) ON row_id = "specObjID" GROUP BY 1, 2"""))
def _(spark, d):
    both = samples(spark, d).select("row_id", "i").join(catalogue(spark, d).select(F.col("specObjID").alias("row_id"), "redshift"), "row_id")
    return both.groupBy(X.inclination_level("i").alias("level"), X.distance_level("redshift").alias("distance")).agg(F.count(F.lit(1)).alias("n"))


@query("scl4_class_code", with_sql(CAT, """SELECT CASE class WHEN 'QSO' THEN 0 WHEN 'GALAXY' THEN 1 ELSE 2 END AS code, count(*) AS n
    FROM cat GROUP BY 1"""))
def _(spark, d):
    return catalogue(spark, d).groupBy(X.class_code("class").alias("code")).agg(F.count(F.lit(1)).alias("n"))


_CREDIT = """SELECT l_orderkey, l_linenumber, greatest(0, 500 * l_linenumber - 1500) AS credit,
    greatest(0, 500 * l_linenumber - 1500) > 0 AS approved FROM lineitem"""


@query("scl5_credit_line", _CREDIT)
def _(spark, d):
    line = X.credit_line("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", line.alias("credit"), (line > 0).alias("approved"))


@query("udf1_score_function", f"SELECT credit, count(*) AS n FROM ({_CREDIT}) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(X.credit_line("l_linenumber").alias("credit")).agg(F.count(F.lit(1)).alias("n"))


@query("scl6_strings", """SELECT page_id, list_extract(string_split(url, '/'), -1) AS last, starts_with(url, 'https') AS secure,
    contains(url, 'example.org') AS org, trim(list_extract(string_split(url, '/'), 4)) AS lang,
    TRY_CAST(list_extract(string_split(url, '/'), 5) AS INT) AS number, url[1:4] AS head FROM pages""")
def _(spark, d):
    url = F.col("url")
    parts = F.split(url, "/")
    return table(spark, d, "pages").select(
        "page_id", last_token("url", "/").alias("last"), F.startswith(url, F.lit("https")).alias("secure"),
        F.contains(url, F.lit("example.org")).alias("org"), F.trim(F.get(parts, 3)).alias("lang"),
        F.get(parts, 4).try_cast("int").alias("number"), F.substring(url, 1, 4).alias("head"))


@query("scl7_units", with_sql({"r": RAYS_SQL}, """SELECT model_id, round(sum(1575 / (0.95 + 0.1 * x)), 4) AS wavelength,
    round(sum((0.95 + 0.1 * x - 1) * 300000), 3) AS velocity, round(sum(delay / 1.5), 6) AS rest FROM r GROUP BY 1"""))
def _(spark, d):
    nu = rays(spark, d).withColumn("nu", 0.95 + 0.1 * F.col("x"))
    return nu.groupBy("model_id").agg(
        F.round(F.sum(X.rest_wavelength("nu", 1575.0)), 4).alias("wavelength"), F.round(F.sum(X.velocity("nu")), 3).alias("velocity"),
        F.round(F.sum(X.rest_frame_time("delay", 0.5)), 6).alias("rest"))


@query("scl8_arrays", """SELECT o_orderkey, len(a) AS n, array_to_string(a, ',') AS items FROM (SELECT o_orderkey, list_filter([
    CASE WHEN o_totalprice > 250000 THEN 'dear' END, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END, o_orderpriority],
    lambda x: x IS NOT NULL) AS a FROM orders)""")
def _(spark, d):
    items = F.array_compact(F.array(F.when(F.col("o_totalprice") > 250000, "dear"),
                                    F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), F.col("o_orderpriority")))
    return table(spark, d, "orders").select("o_orderkey", F.size(items).cast("long").alias("n"), F.array_join(items, ",").alias("items"))


# --- cleaning, bins, scaling, weights -------------------------------------

_BAD = " + ".join(f'CAST("{e}" < 0 AS INT)' for e in S.RADIUS_ERRORS)
_BAD_LIGHT = " + ".join(f'CASE WHEN "{e}" < 0 THEN {m} ELSE 0 END' for m, e in zip(S.BANDS, S.RADIUS_ERRORS))
_LIGHT = " + ".join(S.BANDS)
_REPAIRED = ", ".join(f'CASE WHEN "{e}" < 0 THEN 0 ELSE "{x}" END AS "{x}"' for r, e in zip(S.RADII, S.RADIUS_ERRORS) for x in (r, e))
_KEEP = f"(({_BAD}) = 0 OR (({_BAD}) <= 2 AND ({_BAD_LIGHT}) / ({_LIGHT}) < 0.1))"
REPAIRED_SQL = f"SELECT * REPLACE ({_REPAIRED}) FROM masked WHERE {_KEEP}"
REPAIRED = {**MASKED, "repaired": REPAIRED_SQL}


@query("cln1_repair_sizes", with_sql(REPAIRED, f'SELECT "specObjID", {_q(S.RADII + S.RADIUS_ERRORS)} FROM repaired'))
def _(spark, d):
    return C.repair_sizes(L.all_positive(catalogue(spark, d))).select("specObjID", *S.RADII, *S.RADIUS_ERRORS)


@query("cln2_two_variants", with_sql(REPAIRED, """SELECT 'noSize' AS variant, class, count(*) AS n, round(sum(u + z), 3) AS light FROM masked
    GROUP BY 1, 2 UNION ALL SELECT 'wSize', class, count(*), round(sum(u + z), 3) FROM repaired GROUP BY 1, 2"""))
def _(spark, d):
    no_size, with_size = C.clean(catalogue(spark, d))
    both = L.combine({"noSize": no_size.select("class", "u", "z"), "wSize": with_size.select("class", "u", "z")}, "variant")
    return both.groupBy("variant", "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("u") + F.col("z")), 3).alias("light"))


def bins_sql(source, cols, bins):
    limits = ", ".join(f'min("{c}") AS lo{k}, max("{c}") AS hi{k}' for k, c in enumerate(cols))
    numbers = ", ".join(
        f'CAST(CASE WHEN hi{k} > lo{k} THEN least({bins}, floor(("{c}" - lo{k}) / ((hi{k} - lo{k}) / {bins}::DOUBLE)) + 1) ELSE {bins // 2 + 1} END '
        f'AS INT) AS "{c}"' for k, c in enumerate(cols))
    return f"SELECT * REPLACE ({numbers}) FROM {source}, (SELECT {limits} FROM {source})"


@query("bin1_equal_width", with_sql({"b": bins_sql("lineitem", LINE_MEASURES, 5)},
       f"SELECT {', '.join(LINE_MEASURES)}, count(*) AS n FROM b GROUP BY ALL"))
def _(spark, d):
    return B.bin_equal_width(table(spark, d, "lineitem"), LINE_MEASURES, 5).groupBy(*LINE_MEASURES).agg(F.count(F.lit(1)).alias("n"))


def _grid_sql(select, groups="by_", bins=24):
    return f"SELECT {select} FROM (SELECT DISTINCT model_id FROM r) CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(1, {bins + 1})) LEFT JOIN s USING (model_id, bin)"


_RAY_BIN = "CAST(ceil(x / (CAST(1 AS DOUBLE) / 24)) AS INT)"


_FIRST_BIN = f"greatest(1, {_RAY_BIN})"  # the lower limit belongs to the first bin of a sum


@query("bin2_histogram_sum", with_sql({"r": RAYS_SQL, "s": f"SELECT model_id, {_FIRST_BIN} AS bin, sum(intensity) AS total FROM r WHERE x >= 0 AND x <= 1 GROUP BY 1, 2"},
       _grid_sql("model_id, bin, round((bin - 0.5) * (1::DOUBLE / 24), 9) AS centre, coalesce(total, 0) AS total")))
def _(spark, d):
    out = B.histogram_sum(rays(spark, d), "x", "intensity", 0.0, 1.0, 24, ["model_id"])
    return rounded(out, 9, ["centre"])


@query("bin3_weighted_mean", with_sql({"r": RAYS_SQL, "s": f"""SELECT model_id, {_RAY_BIN} AS bin, sum(delay * intensity) / sum(intensity) AS mean FROM r
       WHERE x > 0 AND x <= 1 GROUP BY 1, 2"""}, _grid_sql("model_id, bin, round((bin - 0.5) * (1::DOUBLE / 24), 9) AS centre, round(mean, 6) AS mean")))
def _(spark, d):
    out = B.binned_weighted_mean(rays(spark, d), "x", "delay", "intensity", 0.0, 1.0, 24, ["model_id"])
    return rounded(rounded(out, 9, ["centre"]), 6, ["mean"])


@query("bin4_ratio", with_sql({"r": RAYS_SQL, "s": f"""SELECT model_id, {_FIRST_BIN} AS bin, sum(phase_weight) AS a, sum(intensity) AS b FROM r
       WHERE x >= 0 AND x <= 1 GROUP BY 1, 2"""}, _grid_sql("""model_id, bin, round((bin - 0.5) * (1::DOUBLE / 24), 9) AS centre,
       round(coalesce(a, 0) / CASE WHEN coalesce(b, 0) = 0 THEN 1 ELSE b END, 6) AS ratio""")))
def _(spark, d):
    out = B.binned_ratio(rays(spark, d), "x", "phase_weight", "intensity", 0.0, 1.0, 24, ["model_id"])
    return rounded(rounded(out, 9, ["centre"]), 6, ["ratio"])


@query("bin5_transfer_function", with_sql({"r": RAYS_SQL, "s": """SELECT bin, (bin - 0.5) * (30::DOUBLE / 60) AS centre, coalesce(total, 0) AS total FROM
       (SELECT CAST(range AS INT) AS bin FROM range(1, 61)) LEFT JOIN (SELECT greatest(1, CAST(ceil(delay / 0.5) AS INT)) AS bin, sum(intensity) AS total FROM r
       WHERE delay >= 0 AND delay <= 30 GROUP BY 1) USING (bin)"""}, """SELECT bin, centre, round(total / (SELECT max(total) FROM s), 9) AS psi,
       round((SELECT sum(centre * total) / sum(total) FROM s), 6) AS mean_delay FROM s"""))
def _(spark, d):
    out = B.transfer_function(rays(spark, d), "delay", "intensity", 60, 30.0)
    return rounded(rounded(out, 9, ["psi"]), 6, ["mean_delay"])



_SCALED = ["o_totalprice", "o_custkey"]


@query("sca1_minmax", "SELECT o_orderkey, " + ", ".join(f"round((o.{c} - lo_{c})::DOUBLE / (hi_{c} - lo_{c}), 9) AS {c}" for c in _SCALED)
       + " FROM orders o, (SELECT " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _SCALED) + " FROM orders)")
def _(spark, d):
    return rounded(Z.scale_minmax(table(spark, d, "orders").select("o_orderkey", *_SCALED), _SCALED), 9)


def _standard_sql(fn):
    return ("SELECT o_orderkey, " + ", ".join(f"round((o.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in _SCALED)
            + " FROM orders o, (SELECT " + ", ".join(f"avg({c}) AS m_{c}, {fn}({c}) AS s_{c}" for c in _SCALED) + " FROM orders)")


@query("sca2_standard_population", _standard_sql("stddev_pop"))
def _(spark, d):
    return rounded(Z.scale_standard(table(spark, d, "orders").select("o_orderkey", *_SCALED), _SCALED), 6)


@query("sca3_standard_sample", _standard_sql("stddev_samp"))
def _(spark, d):
    return rounded(Z.scale_standard(table(spark, d, "orders").select("o_orderkey", *_SCALED), _SCALED, ddof=1), 6)


_W_SIZE = _W_TERMS + [f'1 / nullif("{c}", 0)' for c in S.RADIUS_ERRORS]


@query("wgt1_observation_weights", with_sql({**REPAIRED, **_weights_sql("repaired", _W_SIZE)},
       'SELECT "specObjID", round(raw / (SELECT max(raw) FROM raw), 9) AS weight FROM raw'))
def _(spark, d):
    cleaned = C.clean(catalogue(spark, d))[1]
    return rounded(Z.observation_weights(cleaned, "wSize").select("specObjID", "weight"), 9)


@query("wgt2_power_weight", with_sql(CAT, 'SELECT "specObjID", round(power(redshift, 2), 9) AS weight FROM cat'))
def _(spark, d):
    return rounded(Z.power_weight(catalogue(spark, d), "redshift", 2).select("specObjID", "weight"), 9)


# --- designs -------------------------------------------------------------

@query("gen1_uniform_design", "SELECT o_orderkey, " + ", ".join(
    f'round({lo} + {hi - lo} * {uniform_sql("o_orderkey", f"20/{name}")}, 6) AS "{name}"' for name, (lo, hi) in S.PARAMETER_RANGES.items())
    + " FROM orders")
def _(spark, d):
    return rounded(D.uniform_design(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", seed=20))


_GRID_RANGES = {"i": (0.0, 90.0), "pa": (0.0, 360.0), "Mfac": (0.05, 5.0)}


@query("gen2_grid_design", """WITH n AS (SELECT max(p) AS p FROM (SELECT range AS p FROM range(1, 2000)) WHERE p * p * p <= (SELECT count(*) FROM orders)),
    g AS (SELECT o_orderkey, o_orderkey % (p * p * p) AS id, p FROM orders, n)
    SELECT o_orderkey, id AS grid_id, round(90 * CAST(id // (p * p) AS DOUBLE) / (p - 1), 6) AS i, round(360 * CAST(id // p % p AS DOUBLE) / (p - 1), 6) AS pa,
    round(0.05 + 4.95 * CAST(id % p AS DOUBLE) / (p - 1), 6) AS "Mfac" FROM g""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    n = orders.count()
    points = D.points_per_axis(n, len(_GRID_RANGES)) ** len(_GRID_RANGES)
    placed = orders.withColumn("grid_id", F.col("o_orderkey") % F.lit(points))
    return rounded(placed.join(D.grid_design(spark, n, _GRID_RANGES), "grid_id"))


@query("jn10_param_grid", """WITH s AS (SELECT DISTINCT o_orderstatus AS status FROM orders), p AS (SELECT DISTINCT o_orderpriority AS priority FROM orders)
    SELECT status, priority, c AS "C" FROM s, p, (SELECT unnest([0.1::DOUBLE, 0.5, 1, 2, 3, 4, 5]) AS c)""")
def _(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return D.label_grid(labels, {"C": [0.1, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0]})
