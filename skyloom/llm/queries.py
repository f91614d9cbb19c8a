"""The registered queries of the corpus operators: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, html, language, lines, negatives, packing, periods, pii, quality, secrets, simhash, spans, sql, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_warc_bundles", sql.ARCHIVE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to seekable bundles, then read the bundles."""
    index = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_bundles(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the documents that are not held out, label every document."""
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs, ~language.held_out())
    return language.predict(docs, net).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query("op3_substring_dedup", sql.SPANS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


@query("op4_simhash_groups")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op5_line_templates", sql.LINES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.drop_templates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", "text")


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents")).drop("sanitised")


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).drop("found")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_benchmark_tiling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.flag_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_quality_rules", sql.QUALITY)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; in each document whose checksum ends in 0, the words from some place on first become a repetition."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sums = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = sums.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("w").cast("long"), "g": F.expr("h div 10")})
    changed = F.expr("""CASE WHEN n > 0 THEN array_join(transform(sequence(0, n - 1), i -> w[int(
        CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) div (3 + g % 8)) END)]), ' ') ELSE text END""")
    return periods.find_runs(split.select("doc_id", changed.alias("text"))).drop("runs")


@query("op12_hard_negatives", sql.NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


@query("op13_main_text")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))
