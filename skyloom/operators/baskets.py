"""Transactions, association rules and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.expr import col, distance_level, dominant, inclination_level
from ..session import stored


def baskets_samples(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Peak kind, inclination level and dominant share; both peak items if neither tag is set."""
    peak = (F.when(col("singlePeak"), F.array(F.lit("singlePeak")))
            .when(col("doublePeak"), F.array(F.lit("doublePeak")))
            .otherwise(F.array(F.lit("singlePeak"), F.lit("doublePeak"))))
    rest = F.array(inclination_level("i"), dominant(S.SAMPLE_SHARES))
    return df.select(*[col(k) for k in keep], F.concat(peak, rest).alias("items"))


def baskets_catalogue(df: DataFrame, size: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Dominant magnitude and synthetic flux, class, distance and optionally dominant radius."""
    items = [dominant(S.BANDS), dominant(S.SYNTHETIC_FLUXES), col("class"), distance_level("redshift")]
    if size:
        items.append(dominant(S.RADII))
    return df.select(*[col(k) for k in keep], F.array(*items).alias("items"))


def baskets_from_columns(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``column=value`` items."""
    items = [F.concat(F.lit(c + "="), col(c).cast("string")) for c in cols]
    return df.select(*[col(k) for k in keep], F.array_compact(F.array(*items)).alias("items"))


def frequent_itemsets(df: DataFrame, min_support: float, items: str = "items") -> DataFrame:
    """Exact frequent itemsets ``(items, count, total)`` of baskets of any length, by the FP-growth of Spark ML.

    Every group of items mines the trees of the baskets that reach it, so a
    long basket costs what its frequent subsets cost. A set is frequent from
    ``min_support`` of all baskets on; empty baskets count in the total.
    """
    sets = df.select(F.array_distinct(F.array_compact(col(items))).alias("items")).persist()
    try:
        frequent = FPGrowth(itemsCol="items", minSupport=min_support).fit(sets).freqItemsets
        total = sets.count()
    finally:
        sets.unpersist()
    return frequent.select(F.sort_array("items").alias("items"), F.col("freq").alias("count"), F.lit(total).alias("total"))


def association_rules(df: DataFrame, min_support: float = 0.1, min_confidence: float = 0.2, items: str = "items") -> DataFrame:
    """Rules with one consequent and a non-empty antecedent: support, confidence, lift and count."""
    frequent = stored(frequent_itemsets(df, min_support, items), "itemsets")
    wide = frequent.where(F.size("items") >= 2).withColumn("consequent", F.explode("items")) \
                   .withColumn("antecedent", F.array_except("items", F.array("consequent")))
    left = frequent.select(F.col("items").alias("antecedent"), F.col("count").alias("_na"))
    right = frequent.where(F.size("items") == 1).select(F.col("items")[0].alias("consequent"), F.col("count").alias("_nc"))
    rules = wide.join(left, "antecedent").join(right, "consequent")
    confidence = F.col("count") / F.col("_na")
    return rules.where(confidence >= min_confidence).select(
        F.array_join("antecedent", ",").alias("antecedent"), "consequent",
        (F.col("count") / F.col("total")).alias("support"), confidence.alias("confidence"),
        (confidence / (F.col("_nc") / F.col("total"))).alias("lift"), "count")


def association_rules_fp(df: DataFrame, min_support: float = 0.1, min_confidence: float = 0.2,
                         items: str = "items") -> DataFrame:
    """The same rules from the distributed FP-growth of Spark ML, for baskets of any length."""
    sets = df.select(F.array_distinct(F.array_compact(col(items))).alias("items")).persist()
    try:
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets)
        total = sets.count()
    finally:
        sets.unpersist()
    return model.associationRules.where(F.size("antecedent") > 0).select(
        F.array_join(F.sort_array("antecedent"), ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"),
        "support", "confidence", "lift", F.round(F.col("support") * total).cast("long").alias("count"))


def matching_rules(df: DataFrame, rules: DataFrame, search: str = "search", purchase: str = "purchase") -> DataFrame:
    """Rule rows that fire: the antecedent is the latest search and the consequent was not bought."""
    return df.join(rules, (df[search] == rules["lhs"]) & ~rules["rhs"].eqNullSafe(df[purchase]), "inner")


def recommend(df: DataFrame, rules: DataFrame, search: str = "search", purchase: str = "purchase") -> DataFrame:
    """Own search if it was not bought, then every firing rule in rule order.

    The rules of one antecedent become one ordered list first, so each customer
    row meets at most one joined row and is not regrouped.
    """
    lists = rules.groupBy("lhs").agg(F.sort_array(F.collect_list(F.struct("pos", "rhs"))).alias("_rules"))
    joined = df.join(lists, df[search] == lists["lhs"], "left")

    def fresh(item: Column) -> Column:
        return ~item.eqNullSafe(col(purchase))

    own = F.filter(F.array(col(search)), lambda s: s.isNotNull() & fresh(s))
    fired = F.transform(F.filter(F.col("_rules"), lambda r: fresh(r["rhs"])), lambda r: r["rhs"])
    nothing = F.array().cast("array<string>")
    return joined.withColumn("recommendations", F.concat(own, F.coalesce(fired, nothing))).drop("lhs", "_rules")
