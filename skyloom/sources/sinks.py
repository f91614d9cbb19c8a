"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """Overwrite a table; CSV gets a header and no row numbers."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))
    return path


def write_by_class(df: DataFrame, path: str, column: str = "class", fmt: str = "parquet") -> str:
    """One folder per class value, so that a reader of one class skips the others.

    The rows stay where they are: a repartition by class would send the largest
    class through one task.
    """
    df.write.mode("overwrite").partitionBy(column).format(fmt).save(path)
    return path


def save_clusters(assignments: DataFrame, centres: DataFrame, path: str) -> str:
    """Assignments and centres as two Parquet tables."""
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    centres.write.mode("overwrite").parquet(f"{path}/centres")
    return path


def load_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/assignments"), spark.read.parquet(f"{path}/centres")
