"""Readers for the text formats. All of them take explicit schemas and read in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas as S
from ..functions.expr import col
from ..operators.ordering import ordered

Paths = str | Sequence[str]


def read_table(spark: SparkSession, path: Paths, schema: T.StructType | str, **options) -> DataFrame:
    """CSV with a header line."""
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_matrix(spark: SparkSession, path: Paths, names: Sequence[str]) -> DataFrame:
    """Numeric CSV without header; the names are attached here."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.read.schema(schema).option("header", False).csv(path)


def read_lines(spark: SparkSession, path: Paths, skip: int = 0) -> DataFrame:
    """Text lines as ``value`` without the first ``skip`` lines of every file.

    The skipped lines lie in the first split of a file, and a split is read in
    order by one task, so each task counts on its own: one pass, no shuffle.
    """
    lines = spark.read.text(path)
    if skip == 0:
        return lines
    placed = lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))

    def drop_heads(batches):
        seen: dict[str, int] = {}
        for pdf in batches:
            head = pdf[pdf["_start"] == 0]
            rank = head.groupby("_file").cumcount() + head["_file"].map(lambda f: seen.get(f, 0))
            for name, count in head["_file"].value_counts().items():
                seen[name] = seen.get(name, 0) + int(count)
            yield pdf.drop(index=rank.index[rank < skip])[["value"]]

    return placed.mapInPandas(drop_heads, "value string")


def read_catalogue(spark: SparkSession, paths: Paths, schema: T.StructType = S.CATALOGUE_SCHEMA,
                   comment: str | None = "#") -> DataFrame:
    """Catalogue files of one shape: a table-name line, a header line, then rows.

    A name line that starts with ``comment`` is left to the CSV reader, which
    then checks the header's names against the schema: a name line without
    ``comment`` is an error and not a header. With ``comment=None`` the first
    two lines are skipped as plain lines.
    """
    if comment:
        return read_table(spark, paths, schema, comment=comment, enforceSchema=False)
    rows = read_lines(spark, paths, skip=2)
    return rows.select(F.from_csv("value", schema.simpleString()[len("struct<"):-1].replace(":", " ")).alias("r")).select("r.*")


def read_light_curve_table(spark: SparkSession, path: Paths, skip: int = S.LIGHT_CURVE_HEADER_LINES) -> DataFrame:
    """Whitespace-separated light-curve table after its header lines."""
    parts = F.split(F.trim("value"), r"\s+")
    fields = [F.get(parts, F.lit(k)).try_cast("double").alias(name) for k, name in enumerate(S.LIGHT_CURVE_COLUMNS)]
    return read_lines(spark, path, skip).where(F.trim("value") != "").select(*fields)


def read_baskets(spark: SparkSession, path: Paths, skip: int = 1) -> DataFrame:
    """One basket per line: comma-separated items, each kept once."""
    items = F.transform(F.split("value", ","), lambda x: F.trim(x))
    return read_lines(spark, path, skip).select(F.array_distinct(F.filter(items, lambda x: x != "")).alias("items"))


def fold_triplets(df: DataFrame, order_col: str, v: str = "v", delay: str = "delay", cell: float | None = None) -> DataFrame:
    """Groups of three rows (lower, value, upper) to one measurement with two-sided errors.

    Unless given, ``cell`` is chosen from the count and the limits of the order
    column, for about 50,000 rows a cell.
    """
    if cell is None:
        n, lo, hi = df.agg(F.count(col(order_col)), F.min(col(order_col)).cast("double"), F.max(col(order_col)).cast("double")).first()
        cell = ((hi - lo) / -(-n // 50000) if n else 0.0) or 1.0
    placed = ordered(df, [], order_col, cell=cell, index="_i")
    point, role = F.floor((F.col("_i") - 1) / 3), (F.col("_i") - 1) % 3
    picked = placed.groupBy(point.alias("point")).agg(
        F.avg(col(v)).alias("v"), *[F.max(F.when(role == k, col(delay))).alias(f"_d{k}") for k in range(3)])
    return picked.select("point", "v", F.col("_d1").alias("delay"), (F.col("_d0") - F.col("_d1")).alias("err_down"),
                         (F.col("_d2") - F.col("_d1")).alias("err_up"))
