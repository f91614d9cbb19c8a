"""A training corpus from ``documents``: language, line templates, near-duplicates, benchmark leaks, packing.

Every stage works on what the one before it wrote. The first four keep the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyloom.llm import decontamination, language, lines, packing, simhash
from skyloom.llm.common import order_id, stored, table, text_key

LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; without a letter, or with no language ahead, they go."""
    net = language.fit(docs, ~language.held_out())
    probability = language.score_column(spark, net, "text")
    return docs.filter(probability >= LEAST_SCORE)


def drop_line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that has no others stays whole, for the next stage to find it as a copy."""
    found = lines.drop_templates(docs, spare=True)
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest identifier, then text) of each near-duplicate group, once if rows repeat it."""
    groups = simhash.near_duplicates(docs)
    kept = groups.groupBy("group").agg(F.min(F.struct("k", "h")).alias("first"))
    keyed = docs.select(F.struct("*").alias("row"), order_id().alias("k"), text_key().alias("h"))
    return keyed.join(kept.select("first.k", "first.h").distinct(), ["k", "h"]).dropDuplicates(["k", "h"]).select("row.*")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item's tiles cover."""
    hits = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("k", "h").distinct()
    keyed = docs.select(F.struct("*").alias("row"), order_id().alias("k"), text_key().alias("h"))
    return keyed.join(hits, ["k", "h"], "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_templates", drop_line_templates),
    ("simhash_near_duplicates", keep_one_of_each_group),
    ("benchmark_tiling", drop_leaks),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None  # the network, the fingerprints and the tokenizer have no SQL form; tests/llm checks the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
