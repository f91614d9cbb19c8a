"""Readers and writers on whole tables: written to the shared folder, read back and checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..operators import selection as L
from ..session import scratch_path
from ..sources import readers as I
from ..sources import sinks as O
from ..sources.manifest import IMAGE_SERVICE, PREVIEW_SERVICE, SPECTRUM_SERVICE, retrieval_manifests
from .bindings import CATALOGUE_SQL, catalogue, table, with_sql
from .catalogue_queries import LINE_MEASURES
from .registry import query, rounded
from .series_queries import _wide

ROWS_PER_FILE = 200000


def write_lines(df: DataFrame, head: Sequence[str], key: str, path: str) -> str:
    """Text files with head lines: column ``value`` spread by an integer key over files of bounded size."""
    files = max(3, -(-df.count() // ROWS_PER_FILE))
    lines = df.select((F.col(key) % files).cast("int").alias("file"), F.lit(len(head)).alias("no"), "value")
    tops = df.sparkSession.range(files).select(
        F.col("id").cast("int").alias("file"),
        F.posexplode(F.array(*[F.lit(h) for h in head])).alias("no", "value"))
    both = lines.unionByName(tops).repartition(files, "file").sortWithinPartitions("file", "no")
    both.drop("no").write.partitionBy("file").text(path)
    return f"{path}/file=*"


def _csv_lines(df: DataFrame, key: str, separator: str = ",") -> DataFrame:
    return df.select(F.col(key), F.concat_ws(separator, *[F.col(f"`{c}`").cast("string") for c in df.columns]).alias("value"))


@query("src1_catalogue_files", with_sql({"cat": CATALOGUE_SQL}, f'SELECT {", ".join(chr(34) + c + chr(34) for c in S.CATALOGUE_COLUMNS)} FROM cat'))
def _(spark, d):
    cat = catalogue(spark, d).select(*S.CATALOGUE_COLUMNS)
    path = write_lines(_csv_lines(cat, "specObjID"), ["#Table1", ",".join(S.CATALOGUE_COLUMNS)], "specObjID", scratch_path(spark, "catalogue"))
    return I.read_catalogue(spark, path)


@query("src1_catalogue_plain_names", with_sql({"cat": CATALOGUE_SQL}, """SELECT class, count(*) AS n, round(sum(u), 3) AS u, min(objid) AS objid FROM cat GROUP BY 1"""))
def _(spark, d):
    cat = catalogue(spark, d).select(*S.CATALOGUE_COLUMNS)
    path = write_lines(_csv_lines(cat, "specObjID"), ["Table1", ",".join(S.CATALOGUE_COLUMNS)], "specObjID", scratch_path(spark, "catalogue"))
    return I.read_catalogue(spark, path, comment=None).groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("u"), 3).alias("u"), F.min("objid").alias("objid"))


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
_ORDER_NAMES = [c.split()[0] for c in _ORDERS.split(", ")]


@query("src2_snk1_header_csv", f"SELECT {', '.join(_ORDER_NAMES)} FROM orders")
def _(spark, d):
    path = O.write_table(table(spark, d, "orders").select(*_ORDER_NAMES), scratch_path(spark, "orders"))
    return I.read_table(spark, path, _ORDERS)


@query("src3_numeric_matrix", f"SELECT {', '.join(LINE_MEASURES)} FROM lineitem")
def _(spark, d):
    path = scratch_path(spark, "matrix")
    table(spark, d, "lineitem").select(*LINE_MEASURES).write.option("header", False).csv(path)
    return I.read_matrix(spark, path, LINE_MEASURES)


@query("src4_dropped_column", "SELECT o_orderpriority AS search, o_totalprice, o_orderkey FROM orders")
def _(spark, d):
    path = O.write_table(table(spark, d, "orders").select(*_ORDER_NAMES), scratch_path(spark, "orders"))
    return I.read_table(spark, path, _ORDERS).select(F.col("o_orderpriority").alias("search"), "o_totalprice", "o_orderkey")


@query("src5_light_curve_table", """SELECT CAST(o_orderkey AS DOUBLE) / 100 + 7 AS t, o_totalprice * 8 AS "F_CIV", CAST(o_custkey AS DOUBLE) / 8 AS "e_F_CIV" FROM orders""")
def _(spark, d):
    wide = _wide(spark, d)
    lines = wide.select(F.round(F.col("t") * 100).cast("long").alias("k"),
                        F.concat_ws("   ", *[F.col(c).cast("string") for c in wide.columns]).alias("value"))
    head = [f"header line {k} 1 2 3" for k in range(S.LIGHT_CURVE_HEADER_LINES)]
    return I.read_light_curve_table(spark, write_lines(lines, head, "k", scratch_path(spark, "curve"))).select("t", "F_CIV", "e_F_CIV")


@query("src6_basket_file", """SELECT array_to_string(list_sort(list_distinct([o_orderstatus, o_orderpriority, o_orderstatus])), ';') AS basket, count(*) AS n FROM orders GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "orders").select("o_orderkey", F.concat_ws(",", "o_orderstatus", "o_orderpriority", "o_orderstatus").alias("value"))
    path = write_lines(lines, ["status,priority,again"], "o_orderkey", scratch_path(spark, "baskets"))
    return I.read_baskets(spark, path).groupBy(F.array_join(F.sort_array("items"), ";").alias("basket")).agg(F.count(F.lit(1)).alias("n"))


@query("src7_fold_triplets", """SELECT point, round(avg(o_custkey), 6) AS v, max(CASE WHEN r = 1 THEN o_totalprice END) AS delay,
    round(max(CASE WHEN r = 0 THEN o_totalprice END) - max(CASE WHEN r = 1 THEN o_totalprice END), 4) AS err_down,
    round(max(CASE WHEN r = 2 THEN o_totalprice END) - max(CASE WHEN r = 1 THEN o_totalprice END), 4) AS err_up
    FROM (SELECT *, (row_number() OVER (ORDER BY o_orderkey) - 1) // 3 AS point, (row_number() OVER (ORDER BY o_orderkey) - 1) % 3 AS r FROM orders) GROUP BY 1""")
def _(spark, d):
    out = I.fold_triplets(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "o_custkey", "o_totalprice")
    return rounded(rounded(out, 6, ["v"]), 4, ["err_down", "err_up"])


@query("src8_row_lookup", """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus']) AS name, unnest([CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus]) AS value
    FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 41)""")
def _(spark, d):
    return L.row_lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 41)


@query("src9_retrieval_manifest", with_sql({"cat": CATALOGUE_SQL}, f"""SELECT "specObjID", '{IMAGE_SERVICE}?ra=' || ra || '&dec=' || dec || '&width=512&height=512&scale=0.4&opt=GL' AS url,
    'images/image_' || "specObjID" || '.jpeg' AS target FROM cat UNION ALL SELECT "specObjID", '{PREVIEW_SERVICE}?ID=' || "specObjID", 'spectra/spectrum_' || "specObjID" || '.png' FROM cat
    UNION ALL SELECT "specObjID", '{SPECTRUM_SERVICE}/format=csv/spec=lite?plateid=' || plate || '&mjd=' || mjd || '&fiberid=' || fiberid || '&reduction2d=' || run2d,
    'spectra/spectrum_' || "specObjID" || '.csv' FROM cat"""))
def _(spark, d):
    cat = catalogue(spark, d)
    return retrieval_manifests(cat, [("image", "png"), ("spectrum", "png"), ("spectrum", "csv")])


@query("snk2_write_by_class", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    path = O.write_by_class(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), scratch_path(spark, "by_class"), "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("snk3_save_and_load_clusters", """SELECT label AS cluster, count(*) AS n, round(avg(c), 6) AS centre FROM embeddings
    JOIN (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS c FROM embeddings GROUP BY 1) USING (label) GROUP BY 1""")
def _(spark, d):
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("x"))
    path = O.save_clusters(emb.select("row_id", "cluster"), emb.groupBy("cluster").agg(F.avg("x").alias("centre")), scratch_path(spark, "clusters"))
    assigned, centres = O.load_clusters(spark, path)
    return rounded(assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).join(centres, "cluster"))
