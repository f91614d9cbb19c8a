"""Repeatable samples and splits keyed by a row id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import col, keyed_hash, uniform
from .ordering import ordered


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Bernoulli sample without replacement."""
    return df.where(uniform(key, seed) < fraction)


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly n rows without replacement: the n smallest hashes.

    Counts of 65,536 equal ranges of the hash say in which range the n-th
    smallest lies. Rows below that range are taken by a filter, and only the
    rows of that one range are ranked, so no task sees n rows.
    """
    hashed = df.withColumn("_h", keyed_hash(key, seed)).withColumn("_b", F.shiftright("_h", 44))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    upto = counts.withColumn("_end", F.sum("_m").over(W.orderBy("_b")))  # one row per range
    last = upto.where(F.col("_end") >= n).agg(F.min(F.struct("_b", (F.col("_end") - F.col("_m")).alias("before")))).scalar()
    marked = hashed.withColumn("_last", last)
    below = marked.where(F.col("_last").isNull() | (F.col("_b") < F.col("_last._b")))
    edge = (marked.where(F.col("_b") == F.col("_last._b")).withColumn("_rank", F.row_number().over(W.partitionBy("_b").orderBy("_h", col(key))))
            .where(F.col("_rank") <= n - F.col("_last.before")))
    return below.select(*[col(c) for c in df.columns]).unionByName(edge.select(*[col(c) for c in df.columns]))


def sample_with_replacement(df: DataFrame, n: int, key: str, seed: int = 0, cell: float = 1e5) -> DataFrame:
    """n rows with replacement; ``draw`` numbers them from 0.

    Row numbers come from per-cell counts, so no task ranks the whole table.
    """
    numbered = ordered(df, [], key, cell=cell, index="_idx")
    total = df.agg(F.count(F.lit(1))).scalar()
    draws = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), (F.floor(uniform("id", seed) * total) + 1).alias("_pick"))
    return draws.join(numbered, F.col("_pick") == F.col("_idx")).drop("_pick", "_idx")


def sample_class(df: DataFrame, n: int, key: str, class_col: str = "class", cls=None, seed: int = 0) -> DataFrame:
    """n rows of one class, or of every class; one draw per object.

    The rank filter becomes a top-n on both sides of the shuffle, so a large
    class never travels whole.
    """
    if cls is not None:
        return sample_n(df.where(col(class_col) == cls), n, key, seed)
    rank = F.row_number().over(W.partitionBy(col(class_col)).orderBy(keyed_hash(key, seed), col(key)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def with_split(df: DataFrame, key: str, test: float = 0.3, val: float = 0.0, seed: int = 0) -> DataFrame:
    """Add ``split``: test, val (a share of what is not test) or train."""
    label = F.when(uniform(key, seed) < test, "test")
    if val:
        label = label.when(uniform(key, f"{seed}/val") < val, "val")
    return df.withColumn("split", label.otherwise("train"))


def split(df: DataFrame, key: str, test: float = 0.3, val: float = 0.0, seed: int = 0) -> dict[str, DataFrame]:
    marked = with_split(df, key, test, val, seed)
    return {name: marked.where(F.col("split") == name).drop("split") for name in ("train", "val", "test")}
