"""k-means, silhouettes, model choice, cluster reports and feature dendrograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.expr import col
from .blocks import Blocks, matrix, pack, total
from .ordering import full_grid
from .scaling import scale_minmax, scale_standard
from .sampling import sample_fraction


TASK_BYTES = 64 << 20  # of vectors that a task of a fit keeps
BLOCK_BYTES = 16 << 20  # of a block whose distances to another block are summed


def assemble(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="error").transform(df)


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 0, *, normalise: bool = False,
           thin: float | None = None, key: str = "row_id", max_iter: int = 300, tol: float = 1e-4):
    """Fit Lloyd's algorithm; returns (assignments with ``cluster``, centres, model).

    The fit keeps its vectors, a partition at a time. More than ``TASK_BYTES`` of them are dealt anew, as a file of
    one row group is read by one task, so that a task's memory doesn't grow with the table.
    """
    if normalise:
        df = scale_minmax(df, cols)
    vectors = assemble(df, cols)
    fit_on = (vectors if thin is None else sample_fraction(vectors, thin, key, seed)).select("features")
    parts = -(-fit_on.count() * (100 + 8 * len(cols)) // TASK_BYTES)
    if parts > 1:
        fit_on = fit_on.repartition(max(parts, df.sparkSession.sparkContext.defaultParallelism))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, predictionCol="cluster").fit(fit_on)
    centres = df.sparkSession.createDataFrame(
        [(c, *map(float, centre)) for c, centre in enumerate(model.clusterCenters())],
        "cluster int, " + ", ".join(f"`{c}` double" for c in cols))
    return model.transform(vectors), centres, model


def _block_count(rows: int, width: int, least: int, cores: int) -> int:
    """Blocks of ``least`` rows; of more where that leaves each core four pairs of blocks, up to 8,192 rows or 16 MB: every row is copied once a block."""
    longest = min(8192, BLOCK_BYTES // (8 * max(width, 1)))
    return max(1, -(-rows // max(least, min(longest, rows // (2 * math.ceil(math.sqrt(cores)))))))


def silhouette(df: DataFrame, cols: Sequence[str], label: str = "cluster", key: str = "row_id", *,
               approx: bool = False, blocks: int | None = None, rows_per_block: int = 4096) -> DataFrame:
    """Mean silhouette width, one row.

    Exact Euclidean distances need every pair of rows. The rows are cut into
    blocks; each task gets two blocks and returns, per row, the summed distance
    to every cluster of the other block, so no pair is ever materialised and a
    task holds two blocks only. ``approx`` is the linear-time squared-Euclidean
    silhouette of Spark ML, a different number. Distances come from products of
    the two blocks, those of close pairs from differences. The work stays quadratic.
    """
    if approx:
        vectors = assemble(df, cols)
        score = ClusteringEvaluator(predictionCol=label, featuresCol="features").evaluate(vectors)
        return df.sparkSession.createDataFrame([(float(score),)], "silhouette double")
    if blocks is None:
        blocks = _block_count(df.count(), len(cols), rows_per_block, df.sparkSession.sparkContext.defaultParallelism)
    points = df.select(col(key).alias("_key"), col(label).cast("long").alias("_label"),
                       F.array(*[col(c).cast("double") for c in cols]).alias("_x"))
    points = points.withColumn("_b", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    others = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    rows = points.select("*", F.lit(True).alias("_own"), F.col("_b").cast("long").alias("_i"), F.explode(others).alias("_j"))
    against = points.select("*", F.lit(False).alias("_own"), F.explode(others).alias("_i"), F.col("_b").cast("long").alias("_j"))

    def sums(pdf):
        import numpy as np
        import pandas as pd

        mine, theirs = pdf[pdf["_own"]], pdf[~pdf["_own"]]
        if mine.empty or theirs.empty:
            return pd.DataFrame({"_key": [], "_label": [], "_other": [], "_sum": [], "_n": []})
        a, b = np.vstack(mine["_x"].to_numpy()), np.vstack(theirs["_x"].to_numpy())
        middle = b.mean(axis=0)
        near_a, near_b = a - middle, b - middle
        long_a, long_b = (near_a ** 2).sum(axis=1), (near_b ** 2).sum(axis=1)
        groups, where = np.unique(theirs["_label"].to_numpy(), return_inverse=True)
        member = np.zeros((len(b), len(groups)))
        member[np.arange(len(b)), where] = 1.0
        total = np.empty((len(a), len(groups)))
        for start in range(0, len(a), 256):  # keeps the difference array small and exact
            part, both = a[start:start + 256], long_a[start:start + 256, None] + long_b
            distance = both - 2 * near_a[start:start + 256] @ near_b.T
            i, j = np.nonzero(~(distance >= 1e-6 * both))  # close pairs, where the product has lost digits: by differences
            for at in range(0, len(i), 16384):
                some = slice(at, at + 16384)
                distance[i[some], j[some]] = ((part[i[some]] - b[j[some]]) ** 2).sum(axis=1)
            total[start:start + 256] = np.sqrt(distance) @ member
        return pd.DataFrame({
            "_key": np.repeat(mine["_key"].to_numpy(), len(groups)),
            "_label": np.repeat(mine["_label"].to_numpy(), len(groups)),
            "_other": np.tile(groups, len(a)), "_sum": total.ravel(),
            "_n": np.tile(member.sum(axis=0), len(a)).astype("int64")})

    key_type = points.schema["_key"].dataType.simpleString()
    partial = rows.unionByName(against).groupBy("_i", "_j").applyInPandas(
        sums, f"_key {key_type}, _label long, _other long, _sum double, _n long")
    per_cluster = partial.groupBy("_key", "_label", "_other").agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
    same = F.col("_other") == F.col("_label")
    per_row = per_cluster.groupBy("_key", "_label").agg(
        F.max(F.when(same, F.col("_n"))).alias("_own_n"),
        F.max(F.when(same & (F.col("_n") > 1), F.col("_sum") / (F.col("_n") - 1))).alias("a"),
        F.min(F.when(~same, F.col("_sum") / F.col("_n"))).alias("b"))
    width = F.when(F.col("_own_n") <= 1, F.lit(0.0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return per_row.agg(F.avg(width).alias("silhouette"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (the first of equally near ones) and the squared distance."""
    distance = np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(1), 0.0)
    near = distance.argmin(axis=1)
    return near, distance[np.arange(len(x)), near]


def start_points(sample: np.ndarray, k: int, seed: int, tries: int = 8) -> np.ndarray:
    """Centres of a bounded sample: the best of several fits that begin at rows drawn by their squared distance from the chosen ones."""
    best = None
    for attempt in range(tries):
        rng = np.random.default_rng([seed, k, attempt])
        centres = sample[[rng.integers(len(sample))]]
        while len(centres) < min(k, len(sample)):
            far = _nearest(sample, centres)[1]
            if not far.sum() > 0:
                break
            centres = np.vstack([centres, sample[rng.choice(len(sample), p=far / far.sum())]])
        for _ in range(20):
            near, _ = _nearest(sample, centres)
            centres = np.array([sample[near == c].mean(axis=0) if (near == c).any() else centres[c] for c in range(len(centres))])
        cost = _nearest(sample, centres)[1].sum()
        if best is None or cost < best[0]:
            best = (cost, centres)
    return best[1]


def lloyd(packed: Blocks, starts: Sequence[np.ndarray], max_iter: int = 300, tol: float = 1e-4) -> list[np.ndarray]:
    """Lloyd's algorithm from several sets of centres at once: one read of the rows a step for all that still move by more than ``tol``."""
    centres = [np.asarray(c, np.float64) for c in starts]
    moving = [len(c) > 0 for c in centres]
    for _ in range(max_iter):
        if not any(moving):
            break
        asked = [c for c, m in zip(centres, moving) if m]

        def run(m: np.ndarray, block: int) -> np.ndarray:
            x, times = m[:, :-1], m[:, -1]
            out = []
            for own in asked:
                member = np.zeros((len(x), len(own)))
                member[np.arange(len(x)), _nearest(x, own)[0]] = times
                out.append(np.column_stack([member.T @ x, member.sum(axis=0)]).ravel())
            return np.concatenate(out)

        got, at = total(packed, run, sum(c.size + len(c) for c in asked)), 0
        for k, own in enumerate(centres):
            if moving[k]:
                sums = got[at:at + own.size + len(own)].reshape(len(own), -1)
                at += own.size + len(own)
                updated = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1.0), own)
                moving[k] = bool(np.sqrt(((updated - own) ** 2).sum(axis=1)).max() > tol)
                centres[k] = updated
    return centres


def squared_silhouettes(packed: Blocks, centres: Sequence[np.ndarray]) -> list[float]:
    """Mean squared-Euclidean silhouette of the nearest-centre clusters of each set of centres: two reads for all of them."""
    def sums(m: np.ndarray, block: int) -> np.ndarray:
        x, times = m[:, :-1], m[:, -1]
        out = []
        for own in centres:
            member = np.zeros((len(x), len(own)))
            member[np.arange(len(x)), _nearest(x, own)[0]] = times
            out.append(np.column_stack([member.T @ x, member.T @ (x ** 2).sum(1), member.sum(axis=0)]).ravel())
        return np.concatenate(out)

    got, at, known = total(packed, sums, sum(c.size + 2 * len(c) for c in centres)), 0, []
    for own in centres:
        part = got[at:at + own.size + 2 * len(own)].reshape(len(own), -1)
        at += own.size + 2 * len(own)
        known.append((part[:, :-2] / np.maximum(part[:, -1:], 1), part[:, -2] / np.maximum(part[:, -1], 1), part[:, -1]))

    def widths(m: np.ndarray, block: int) -> np.ndarray:
        x, times = m[:, :-1], m[:, -1]
        out = []
        for own, (mean, square, size) in zip(centres, known):
            near = _nearest(x, own)[0]
            apart = (x ** 2).sum(1)[:, None] - 2 * x @ mean.T + square  # mean squared distance from a row to each cluster
            rows = np.arange(len(x))
            a = apart[rows, near] * size[near] / np.maximum(size[near] - 1, 1)
            apart[rows, near] = np.inf
            apart[:, size == 0] = np.inf
            b = apart.min(axis=1)
            most = np.maximum(a, b)
            with np.errstate(invalid="ignore", divide="ignore"):
                width = np.where((size[near] > 1) & np.isfinite(b) & (most > 0), (b - a) / most, 0.0)
            out.append(times @ width)
        return np.array(out)

    return [float(v) / max(packed.rows, 1) for v in total(packed, widths, len(centres))]


def select_k(df: DataFrame, cols: Sequence[str], ks: Sequence[int] = range(2, 11), seed: int = 0, *, normalise: bool = False, thin: float | None = None,
             key: str = "row_id", approx: bool = True, sample_rows: int = 4096):
    """Fit every k in the same passes, keep the best silhouette (the smallest k on ties), refit on all rows if ``thin`` left some out.

    Rows are packed once. Centres begin at those of the ``sample_rows`` rows with
    the smallest hash, then all rows move the centres of all k together, one
    read a step; two more reads score all k. ``approx=False`` scores with exact
    Euclidean distances instead, k after k. ``normalise`` applies to scoring and
    result alike. Returns the score table and (assignments, centres, the best
    centres as an array). Rows with a null column take no part in the fits and
    get no cluster.
    """
    ks, cols = list(ks), list(cols)
    data = scale_minmax(df, cols) if normalise else df
    base = data if thin is None else sample_fraction(data, thin, key, seed)
    wide = {c: col(c) for c in cols}
    packed = pack(base, wide, name="cluster-rows").cache()
    whole = None
    try:
        blocks_needed = max(1, -(-sample_rows // 256))  # blocks hold hashed rows: a few of them are a sample
        parts = packed.frame.orderBy(F.xxhash64(F.lit(seed), "block"), "block").limit(blocks_needed).collect()
        sample = np.concatenate([matrix(r["data"], len(cols)) for r in parts])[:sample_rows, :-1] if parts else np.zeros((0, len(cols)))
        starts = [start_points(sample, k, seed) if len(sample) else np.zeros((0, len(cols))) for k in ks]
        centres = lloyd(packed, starts) if len(sample) else starts
        if not len(sample):
            scores = [0.0] * len(ks)
        elif approx:
            scores = squared_silhouettes(packed, centres)
        else:
            scores = [float(silhouette(assign(base, cols, c), cols, "cluster", key).first()[0] or 0.0) for c in centres]
        best = max(range(len(ks)), key=lambda i: (scores[i], -i))
        if thin is not None and len(sample):
            whole = pack(data, wide, name="cluster-rows").cache()
            centres[best] = lloyd(whole, [centres[best]])[0]
    finally:
        packed.close()
        if whole is not None:
            whole.close()
    table = df.sparkSession.createDataFrame([(int(k), s) for k, s in zip(ks, scores)], "k int, score double").withColumn("best", F.col("k") == ks[best])
    named = df.sparkSession.createDataFrame([(c, *map(float, row)) for c, row in enumerate(centres[best])], "cluster int, " + ", ".join(f"`{c}` double" for c in cols))
    return table, (assign(data, cols, centres[best]), named, centres[best])


def assign(df: DataFrame, cols: Sequence[str], centres: np.ndarray, name: str = "cluster") -> DataFrame:
    """Rows with the number of the nearest centre, null where a column is."""
    cols = list(cols)

    @F.pandas_udf("int")
    def nearest(x: pd.Series) -> pd.Series:
        rows = np.array([[np.nan if v is None else v for v in r] for r in x], dtype=np.float64).reshape(len(x), len(cols))
        known = ~np.isnan(rows).any(axis=1)
        out = pd.Series([None] * len(x), dtype=object)
        if known.any() and len(centres):
            out[known] = _nearest(rows[known], centres)[0]
        return out

    return df.withColumn(name, nearest(F.array(*[col(c).cast("double") for c in cols])))


def cluster_class_lift(df: DataFrame, cluster: str = "cluster", cls: str = "class") -> DataFrame:
    """(share of the class in the cluster - overall share) / overall share for every pair; missing pairs are -1."""
    cells = df.groupBy(col(cluster).alias("cluster"), col(cls).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    grid = full_grid(cells, "cluster", "class")  # clusters x classes rows from here on
    total = F.sum("n").over(W.partitionBy())
    share = F.col("n") / F.sum("n").over(W.partitionBy("cluster"))
    expected = F.sum("n").over(W.partitionBy("class")) / total
    return grid.select("cluster", "class", "n", ((share - expected) / expected).alias("lift"))


def cluster_means(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean of every feature per cluster in long form."""
    means = df.groupBy(col(cluster).alias("cluster")).agg(*[F.avg(col(c)).alias(c) for c in cols])
    return means.unpivot("cluster", [col(c) for c in cols], "feature", "centre")


def feature_cosine(df: DataFrame, cols: Sequence[str], standardise: bool = True) -> DataFrame:
    """Cosine between every two columns from one aggregate of all products."""
    if standardise:
        df = scale_standard(df, cols, ddof=1)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = df.agg(*[F.sum(col(cols[i]) * col(cols[j])).alias(f"d_{i}_{j}") for i, j in pairs])
    rows = F.array(*[
        F.struct(F.lit(cols[i]).alias("left"), F.lit(cols[j]).alias("right"),
                 (F.col(f"d_{i}_{j}") / F.nullif(F.sqrt(F.col(f"d_{i}_{i}") * F.col(f"d_{j}_{j}")), F.lit(0.0))).alias("cosine"))
        for i, j in pairs])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def feature_dendrogram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Ward merges (``ward.D``) of the columns by 1 - cosine.

    The table is reduced to one p x p matrix on Spark; the p - 1 merges work on
    that matrix only. A merged node is named by its step as ``#step``.
    """
    p = len(cols)
    at = {c: i for i, c in enumerate(cols)}
    distance = np.full((p, p), np.inf)
    for row in feature_cosine(df, cols).collect():  # p (p + 1) / 2 rows, set by the column list
        i, j = at[row["left"]], at[row["right"]]
        if i != j:
            distance[i, j] = distance[j, i] = 1.0 - (row["cosine"] or 0.0)
    names, sizes, active, merges = list(cols), [1] * p, list(range(p)), []
    for step in range(1, p):
        sub = distance[np.ix_(active, active)]
        a, b = np.unravel_index(np.argmin(sub), sub.shape)
        i, j = sorted((active[a], active[b]))
        height = float(distance[i, j])
        for k in active:
            if k not in (i, j):
                ni, nj, nk = sizes[i], sizes[j], sizes[k]
                distance[i, k] = distance[k, i] = (
                    (ni + nk) * distance[i, k] + (nj + nk) * distance[j, k] - nk * height) / (ni + nj + nk)
        merges.append((step, names[i], names[j], height, sizes[i] + sizes[j]))
        sizes[i] += sizes[j]
        names[i] = f"#{step}"
        active.remove(j)
    return df.sparkSession.createDataFrame(merges, "step int, left string, right string, height double, size int")
