"""Ordered work inside a series without putting a whole series into one task.

A series is cut into cells ``floor(order / cell)``. Rows are only ever sorted
inside one (series, cell) group; what has to cross a cell border (row counts,
first and last row) comes from one summary row per cell, so a series that holds
a third of the table is spread over as many tasks as it has cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import all_of, col

BLOCK = 65536


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys and keeps the key columns once."""
    if not keys:
        raise ValueError("join keys are needed")
    renamed = right.select([col(c).alias(f"__{c}") if c in keys else col(c) for c in right.columns])
    condition = all_of(left[f"`{k}`"].eqNullSafe(renamed[f"`__{k}`"]) for k in keys)
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add per-group aggregates to every row.

    The aggregate is combined before its shuffle and joined back; adaptive
    execution broadcasts it only when its measured size allows, and otherwise
    splits skewed groups. Without keys it is one scalar subquery.
    """
    if not keys:
        row = df.agg(F.struct(*[v.alias(k) for k, v in aggregates.items()]).alias("_s")).scalar()
        return df.withColumn("_s", row).select("*", *[F.col(f"_s.{k}").alias(k) for k in aggregates]).drop("_s")
    groups = df.groupBy(*[col(k) for k in keys]).agg(*[v.alias(k) for k, v in aggregates.items()])
    return join_null_safe(df, groups, keys)


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    cell: float = 1.0,
    ties: Sequence[str] = (),
    previous: Sequence[str] = (),
    following: Sequence[str] = (),
    first: Sequence[str] = (),
    index: str | None = None,
    size: str | None = None,
) -> DataFrame:
    """Add rank, series size, neighbours or first-row values, ordered by ``order``.

    ``previous``/``following``/``first`` name columns; they come back as
    ``prev_x``, ``next_x`` and ``first_x``. ``index`` is 1-based. Choose ``cell``
    so that one cell of one series fits a task.
    """
    keys = list(keys)
    rank_by = [col(order), *[col(t) for t in ties]]
    sort_key = F.struct(*rank_by)
    # one struct of series and cell, NULLs included: the join and the windows below then share one exchange of the table
    base = df.withColumn("_part", F.struct(*[col(k) for k in keys], F.floor(col(order) / F.lit(float(cell))).alias("_cell")))

    summary = [F.count(F.lit(1)).alias("_n")]
    if previous:
        summary.append(F.max_by(F.struct(*[col(c) for c in previous]), sort_key).alias("_last"))
    heads = list(dict.fromkeys([*following, *first]))
    if heads:
        summary.append(F.min_by(F.struct(*[col(c) for c in heads]), sort_key).alias("_head"))
    cells = base.groupBy("_part").agg(*summary)

    series = [F.col("_part").getField(k) for k in keys]
    by_cell = W.partitionBy(*series).orderBy(F.col("_part._cell"))
    before = by_cell.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*series)
    edges = [F.col("_part")]
    if index:
        edges.append(F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if size:
        edges.append(F.sum("_n").over(whole).alias(size))
    if previous:
        edges.append(F.lag("_last").over(by_cell).alias("_in"))
    if following:
        edges.append(F.lead("_head").over(by_cell).alias("_out"))
    if first:
        edges.append(F.first("_head").over(by_cell.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_first"))
    joined = base.join(cells.select(*edges), "_part")

    inside = W.partitionBy("_part").orderBy(*rank_by)
    out = [col(c) for c in df.columns]
    if index:
        out.append((F.col("_before") + F.row_number().over(inside)).alias(index))
    if size:
        out.append(F.col(size))
    for c in previous:
        out.append(F.when(F.row_number().over(inside) == 1, F.col("_in").getField(c))
                   .otherwise(F.lag(col(c)).over(inside)).alias(f"prev_{c}"))
    for c in following:
        out.append(F.when(F.lead(F.lit(1)).over(inside).isNull(), F.col("_out").getField(c))
                   .otherwise(F.lead(col(c)).over(inside)).alias(f"next_{c}"))
    for c in first:
        out.append(F.col("_first").getField(c).alias(f"first_{c}"))
    return joined.select(*out)


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    build,
    *,
    before: int,
    after: int,
    block: int = BLOCK,
) -> DataFrame:
    """Window expressions that look at most ``before``/``after`` rows away.

    ``index`` is a dense integer position. Rows near a block border are copied
    to the neighbouring block as a halo, so groups stay at ``block`` rows plus
    the halo however long a series is. ``build(window)`` returns the columns.
    """
    reach = max(before, after)
    block = max(block, reach)
    home = F.floor((col(index) - 1) / F.lit(block))
    low = F.floor((col(index) - 1 - after) / F.lit(block))
    high = F.floor((col(index) - 1 + before) / F.lit(block))
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(low, high)))
    window = W.partitionBy(*[col(k) for k in keys], "_block").orderBy(col(index))
    return spread.select("*", *build(window)).where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def explode_range(df: DataFrame, low: Column, high: Column, name: str, block: int = BLOCK) -> DataFrame:
    """One row per integer in [low, high], unfolded block by block so that no row holds a long array."""
    return (
        df.withColumn("_lo", low.cast("long"))
        .withColumn("_hi", high.cast("long"))
        .where(F.col("_lo") <= F.col("_hi"))
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / block))))
        .withColumn(name, F.explode(F.sequence(
            F.col("_lo") + F.col("_b") * block,
            F.least(F.col("_hi"), F.col("_lo") + (F.col("_b") + 1) * block - 1))))
        .drop("_lo", "_hi", "_b")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    fractions: Sequence[float],
    accuracy: int = 10000,
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, from two passes.

    The first pass brackets every wanted rank by approximate quantiles, whose
    rank error is bounded by 1 / ``accuracy`` of the rows whatever the values
    are. The second counts the rows below each bracket and the distinct values
    inside, so only a few ten-thousandths of the rows are ranked. In a group of
    few rows the share of a bracket is less than a row, and an order statistic
    may be the next value outside, so that is kept on both sides.
    """
    keys = list(keys)
    whole = [col(k) for k in keys]
    clean = df.where(col(value).isNotNull() & ~F.isnan(col(value))).select(*whole, col(value).cast("double").alias("_v"))
    sides = [min(1.0, max(0.0, f + 3 * d / accuracy)) for f in fractions for d in (-1, 1)]
    ranged = attach(clean, keys, _n=F.count(F.lit(1)), _b=F.percentile_approx("_v", sides, accuracy))
    inside = [(F.col("_v") >= F.col("_b")[2 * i]) & (F.col("_v") <= F.col("_b")[2 * i + 1]) for i in range(len(fractions))]
    near = reduce(lambda x, y: x | y, inside)
    counted = ranged.groupBy(*whole, "_n", "_b", F.when(near, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_k"), *[F.array(*[side(i) for i in range(len(fractions))]).alias(name) for name, side in (
            ("_under", lambda i: F.count_if(F.col("_v") < F.col("_b")[2 * i])),
            ("_less", lambda i: F.max(F.when(F.col("_v") < F.col("_b")[2 * i], F.col("_v")))),
            ("_more", lambda i: F.min(F.when(F.col("_v") > F.col("_b")[2 * i + 1], F.col("_v")))))])
    group = W.partitionBy(*whole)
    below, less, more = (F.array(*[fn(F.col(name)[i]).over(group) for i in range(len(fractions))])
                         for name, fn in (("_under", F.sum), ("_less", F.max), ("_more", F.min)))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(f)).alias("q"), (F.lit(float(f)) * (F.col("_n") - 1)).alias("pos"))
                       for i, f in enumerate(fractions)])
    held = (counted.withColumns({"_below": below, "_less": less, "_more": more}).where(F.col("_v").isNotNull())
            .select(*whole, "_v", "_k", "_b", "_below", "_less", "_more", F.explode(wanted).alias("_x"))
            .where((F.col("_v") >= F.element_at("_b", 2 * F.col("_x.i") + 1)) & (F.col("_v") <= F.element_at("_b", 2 * F.col("_x.i") + 2))))
    in_bracket = W.partitionBy(*whole, "_x.i").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    placed = held.withColumn("_to", F.element_at("_below", F.col("_x.i") + 1) + F.sum("_k").over(in_bracket)) \
                 .withColumn("_from", F.col("_to") - F.col("_k"))
    low, high = F.floor("_p"), F.ceil("_p")
    hit = F.when((F.floor(F.col("_x.pos")) < F.col("_to")) & (F.ceil(F.col("_x.pos")) >= F.col("_from")), F.col("_v"))
    # of the two order statistics around a rank, the lower is the minimum of the hits, the upper the maximum, unless it is next to the bracket
    outside = lambda rank, inner: F.when(rank < F.col("_start"), F.col("_less")).when(rank >= F.col("_stop"), F.col("_more")).otherwise(inner)
    return (
        placed.groupBy(*whole, F.col("_x.q").alias("fraction"))
        .agg(F.min(hit).alias("_a"), F.max(hit).alias("_b"), F.first("_x.pos").alias("_p"), F.min("_from").alias("_start"), F.max("_to").alias("_stop"),
             F.first(F.element_at("_less", F.col("_x.i") + 1)).alias("_less"), F.first(F.element_at("_more", F.col("_x.i") + 1)).alias("_more"))
        .withColumns({"_a": outside(low, F.col("_a")), "_b": outside(high, F.col("_b"))})
        .select(*whole, "fraction", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_p") - low)).alias("quantile"))
    )


def full_grid(counts: DataFrame, left: str, right: str, n: str = "n", same_labels: bool = False) -> DataFrame:
    """Every (left, right) pair of a small count table, zero where it is missing.

    The counts (labels x labels rows) are packed into one row and unfolded
    again, so whatever produced them runs once.
    """
    packed = counts.agg(F.collect_list(F.struct(col(left).alias("a"), col(right).alias("b"), col(n).alias("n"))).alias("_cells"))
    lefts = F.transform("_cells", lambda c: c["a"])
    rights = F.transform("_cells", lambda c: c["b"])
    if same_labels:
        lefts = rights = F.array_union(lefts, rights)
    rows = packed.select("_cells", F.array_distinct(rights).alias("_right"), F.explode(F.array_distinct(lefts)).alias(left))
    mine = F.filter("_cells", lambda c: c["a"].eqNullSafe(F.col(left)))
    cells = rows.withColumn("_cells", mine).select("_cells", left, F.explode("_right").alias(right))
    hit = F.get(F.filter("_cells", lambda c: c["b"].eqNullSafe(F.col(right))), F.lit(0))["n"]
    return cells.select(left, right, F.coalesce(hit, F.lit(0).cast("long")).alias(n))
