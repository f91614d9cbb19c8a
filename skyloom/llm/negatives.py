"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by summed bounds, certified stops."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import map_texts, stored

LARGEST = 2 ** 28  # of a component after scaling: 64 products of two of them fit a long


class Codebooks(NamedTuple):
    """Codes of the two halves of a vector."""

    halves: tuple[np.ndarray, np.ndarray]  # codes x dimensions
    dims: int

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.dims // 2
        return vectors[:, :cut], vectors[:, cut:]


class Cells(NamedTuple):
    """What is known of the cells: rows in each, and how far rows lie from the code of either half."""

    counts: np.ndarray  # codes x codes
    radii: tuple[np.ndarray, np.ndarray]


def lloyd(points: np.ndarray, codes: int, steps: int = 8) -> np.ndarray:
    """Code vectors of a sample, begun at its first distinct points."""
    _, first = np.unique(points, axis=0, return_index=True)
    centres = points[np.sort(first)[:codes]].astype(np.float64)
    for _ in range(steps):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * points @ centres.T, axis=1)


def half_bounds(anchors: np.ndarray, books: Codebooks, cells: Cells) -> list[np.ndarray]:
    """For each half, anchors x codes: no row with that code has a larger half score."""
    return [part @ book.T + np.sqrt((part ** 2).sum(1))[:, None] * radius
            for part, book, radius in zip(books.split(anchors.astype(np.float64)), books.halves, cells.radii)]


def visit(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence heap: pairs of codes by falling sum of their half bounds."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = left[a].tolist(), right[b].tolist()
    codes_a, codes_b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, codes_a[i], codes_b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


def wanted_cells(anchors: np.ndarray, books: Codebooks, cells: Cells, first: int, least: np.ndarray | None) -> set[int]:
    """Cells for a block of anchors: those of the first ``first`` rows of each, or, given ``least``, the rest of what can score that much."""
    bounds = half_bounds(anchors, books, cells)
    codes = len(books.halves[1])
    counts = cells.counts.tolist()
    opened: set[int] = set()
    more: set[int] = set()
    for q in range(len(anchors)):
        rows = 0
        for bound, i, j in visit(bounds[0][q], bounds[1][q]):
            if rows >= first and (least is None or bound + 1e-6 * (1 + abs(bound)) < least[q]):
                break  # certified: no row of this cell or of any later one scores as much
            if counts[i][j]:
                (opened if rows < first else more).add(i * codes + j)
                rows += counts[i][j]
    return opened if least is None else more - opened


BLOCK = "cell int, part int, n int, ids binary, labels binary, vectors binary"


def pack(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: identifiers, labels and vectors as arrays of numbers, by identifier. Equal rows are one."""
    grouped = rows.groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("vec_id", "label", "vector"))).alias("rows"))

    def run(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            out: dict[str, list] = {n: [] for n in ("n", "ids", "labels", "vectors")}
            for i in range(len(cols["rows"])):
                own = cols["rows"][i].values
                out["n"].append(len(own))
                out["ids"].append(own.field("vec_id").to_numpy().astype("<i8").tobytes())
                out["labels"].append(own.field("label").to_numpy().astype("<i8").tobytes())
                out["vectors"].append(b"".join(own.field("vector").to_pylist()))
            yield {**{c: cols[c] for c in by}, **out}

    kinds = {"cell": "int", "part": "int", "block": "long"}
    return map_texts(grouped, run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n int, ids binary, labels binary, vectors binary")


class Best:
    """The best rows so far of every wish of a block of anchors: a wish is an anchor, a range of scores and whether labels agree."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, keep: int):
        self.anchor, self.low, self.high, self.same, self.keep = anchor, low.astype(np.float64), high.astype(np.float64), same, keep
        self.wish = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.ident = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, agree: np.ndarray, other: np.ndarray) -> None:
        """``scores``: anchors x rows; ``agree``: labels are equal; ``other``: not the anchor itself."""
        found = scores[self.anchor]
        fits = (found >= self.low[:, None]) & (found <= self.high[:, None]) & (agree[self.anchor] == self.same) & other[self.anchor]
        wish, column = np.nonzero(fits)
        if not len(wish):
            return
        wish = np.concatenate([self.wish, wish])
        score = np.concatenate([self.score, found[fits].astype(np.int64)])
        ident = np.concatenate([self.ident, ids[column]])
        order = np.lexsort((ident, -score, wish))
        wish, score, ident = wish[order], score[order], ident[order]
        begins = np.searchsorted(wish, wish)
        rank = np.arange(len(wish)) - begins
        kept = rank < self.keep
        self.wish, self.score, self.ident = wish[kept], score[kept], ident[kept]
        full = rank == self.keep - 1
        self.low[wish[full]] = score[full]  # equal scores may still come with a smaller identifier


def matrix(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, dims).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums stay below 2^53, else as integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return a @ b.T if most < 2 ** 53 else a.astype(np.int64) @ b.astype(np.int64).T


def wishes_of(listed: list[dict], count: int, positives: bool, shares: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Anchor, lowest and highest score of every wish, with what names it."""
    if positives:
        return np.arange(count), np.full(count, -np.inf), np.full(count, np.inf), [(i, None, None) for i in range(count)]
    named = sorted((w["i"], -w["score"], w["id"]) for w in listed or ())
    score = np.array([-s for _, s, _ in named], dtype=object)
    low = np.array([-(-shares[0] * s // 100) for s in score], dtype=np.float64)
    high = np.array([shares[1] * s // 100 for s in score], dtype=np.float64)
    return np.array([i for i, _, _ in named], dtype=np.int64), low, high, [(i, d, -s) for i, s, d in named]


def mine(rows: DataFrame, anchor: Column, ident: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
         negatives: int = 3, shares: tuple[int, int] = (50, 95), scale: int = 256, cell_rows: int = 256, fit_rows: int = 8192,
         most_codes: int = 512, first: int = 2048, anchors_a_block: int = 1024) -> DataFrame:
    """For every anchor and each of its nearest rows of the same label, the best rows of other labels inside a window of scores.

    ``anchor`` is a condition on the identifier column. A component becomes
    ``floor(scale * x)``; a score is an integer inner product. Higher scores
    come first, ties by smaller identifier. The window is from ``shares[0]`` to
    ``shares[1]`` hundredths of the positive's score.

    *Index.* Either half of a vector has a codebook, fitted to the ``fit_rows``
    rows with the smallest hash, of as many codes as make ``cell_rows`` rows a
    cell on average (``most_codes`` at most, which bounds what is broadcast and
    collected: a row per cell). All rows are indexed. Cells are stored in blocks
    of about ``cell_rows`` rows by a hash of the identifier, so a vector that
    very many rows share is spread. *Search.* A multi-sequence heap yields an
    anchor's cells by falling sum of two half-score bounds, product with the
    code plus length times radius. A first pass scores the cells of its first
    ``first`` rows; a second goes on until the next bound is below the lowest
    score that could still enter (the last positive's; of a window, its last
    negative's or its lower end). That certifies the result: it is exact. A
    block of anchors scores what any of them visits; blocks of cells are dealt
    by (block of anchors, slice of cells), as many slices as there are 256
    blocks, and a task streams them.

    Rows with a null identifier, label, vector or component, with a component
    that is not finite, or with one beyond 2^28 after scaling (products would
    leave a long) take no part. Shorter vectors count as followed by zeros.
    Equal rows count once; a row with the anchor's identifier is never its
    positive or negative. Anchors without positives, or windows without
    negatives, give no rows; an empty table gives none. Further columns are
    ignored, whatever their names.
    """
    spark = rows.sparkSession
    whole = f"transform({vector}, x -> floor({scale} * CAST(x AS double)))"
    # not-a-number and infinities: the scaled component must lie inside the bound, and a null one fails the test too
    fit = (f"{ident} IS NOT NULL AND {label} IS NOT NULL AND {vector} IS NOT NULL AND coalesce(forall({vector}, x -> x IS NOT NULL AND NOT isnan(x)"
           f" AND abs(CAST(x AS double)) * {scale} < {LARGEST}), false)")
    usable = rows.filter(fit).select(F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                                     F.expr(whole).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    size = usable.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims, codes = max(2, size["dims"] or 0), int(np.clip(round((size["n"] / cell_rows) ** 0.5), 1, most_codes))

    def padded(values: Iterable[list]) -> np.ndarray:
        return np.array([list(v) + [0] * (dims - len(v)) for v in values], dtype=np.int64).reshape(-1, dims)

    sample = padded(r["v"] for r in usable.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(fit_rows).select("v").collect())
    if not len(sample):
        sample = np.zeros((1, dims), np.int64)
    cut = dims // 2
    books = Codebooks((lloyd(sample[:, :cut].astype(np.float64), codes), lloyd(sample[:, cut:].astype(np.float64), codes)), dims)

    def assign(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            v = padded(cols["v"].to_pylist())
            near, far = [], []
            for part, book in zip(books.split(v.astype(np.float64)), books.halves):
                code = nearest(part, book)
                near.append(code)
                far.append(np.sqrt(((part - book[code]) ** 2).sum(1)))
            packed = v.astype("<i4")
            yield {"vec_id": cols["vec_id"], "label": cols["label"], "anchor": cols["anchor"], "vector": [x.tobytes() for x in packed],
                   "a": near[0], "b": near[1], "ra": far[0], "rb": far[1]}

    placed = stored(map_texts(usable, assign, "vec_id long, label long, anchor boolean, vector binary, a int, b int, ra double, rb double"), "negatives-rows")
    width = len(books.halves[1])
    cell = (F.col("a") * width + F.col("b")).cast("int").alias("cell")
    known = placed.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).collect()
    counts = np.zeros((len(books.halves[0]), width), np.int64)
    radii = (np.zeros(len(books.halves[0])), np.zeros(width))
    table, blocks_in_all, block, taken = [], 0, 0, 0
    for r in sorted(known, key=lambda r: (r["a"], r["b"])):
        counts[r["a"], r["b"]] = r["n"]
        radii[0][r["a"]], radii[1][r["b"]] = max(radii[0][r["a"]], r["ra"]), max(radii[1][r["b"]], r["rb"])
        parts = -(-r["n"] // cell_rows)
        # anchors of neighbouring cells share a block; a cell with many gets several of its own
        several = -(-r["anchors"] // anchors_a_block)
        if several > 1 or taken + r["anchors"] > anchors_a_block:
            block, taken = block + 1, 0
        table.append((r["a"] * width + r["b"], parts, block, max(1, several)))
        block, taken = (block + several, 0) if several > 1 else (block, taken + r["anchors"])
        blocks_in_all += parts
    cells = Cells(counts, radii)
    layout = F.broadcast(spark.createDataFrame(table or [(0, 1, 0, 1)], "cell int, parts int, first_block long, anchor_parts int"))
    slices_in_all = -(-blocks_in_all // 256) or 1
    laid = placed.select("vec_id", "label", "vector", "anchor", cell).join(layout, "cell")
    spread = F.xxhash64(F.lit(3), "vec_id")
    index = stored(pack(laid.select("cell", F.pmod(spread, "parts").cast("int").alias("part"), "vec_id", "label", "vector"), ["cell", "part"]), "negatives-cells")
    asked = stored(pack(laid.filter("anchor").select((F.col("first_block") + F.pmod(spread, "anchor_parts")).alias("block"), "vec_id", "label", "vector"),
                        ["block"]), "negatives-anchors")

    def scored(state: DataFrame, want_positives: bool, second: bool) -> DataFrame:
        """One pass: ``state`` has the blocks of anchors with ``wishes`` (the positives) and ``so_far``; gives the best per wish and task."""
        keep = positives if want_positives else negatives

        def begin(count: int, listed: list[dict], so_far: list[dict]) -> tuple[Best, list, np.ndarray]:
            who, low, high, names = wishes_of(listed, count, want_positives, shares)
            best = Best(who, low, high, want_positives, keep)
            place = {(i, d): w for w, (i, d, _) in enumerate(names)}
            grouped: dict[int, list[int]] = {}
            for x in so_far or ():
                grouped.setdefault(place[x["i"], x["positive"]], []).append(x["score"])
            for w, scores in grouped.items():
                if len(scores) >= keep:
                    best.low[w] = max(best.low[w], sorted(scores)[-keep])
            least = np.full(count, np.inf)
            np.minimum.at(least, who, np.where(best.low <= best.high, best.low, np.inf))
            return best, names, least

        def probe(slices: Iterable[dict]) -> Iterator[dict]:
            for cols in slices:
                for k in range(len(cols["block"])):
                    v = matrix(cols["vectors"][k].as_py(), dims)
                    least = begin(len(v), cols["wishes"][k].as_py(), cols["so_far"][k].as_py())[2] if second else None
                    found = sorted(wanted_cells(v, books, cells, first, least))
                    yield {"block": [cols["block"][k].as_py()] * len(found), "cell": found}

        def score(slices: Iterable[dict]) -> Iterator[dict]:
            now, best, names, anchors = None, None, [], None

            def results() -> dict:
                picked = [names[w] for w in best.wish.tolist()]
                return {"block": [now] * len(picked), "i": [p[0] for p in picked], "positive": [p[1] for p in picked], "positive_score": [p[2] for p in picked],
                        "id": best.ident, "score": best.score}

            for cols in slices:
                for k in range(len(cols["block"])):
                    ids = np.frombuffer(cols["ids"][k].as_py(), "<i8")
                    labels = np.frombuffer(cols["labels"][k].as_py(), "<i8")
                    v = matrix(cols["vectors"][k].as_py(), dims)
                    if cols["anchors"][k].as_py():
                        if best is not None:
                            yield results()
                        now, anchors = cols["block"][k].as_py(), (ids, labels, v)
                        best, names, _ = begin(len(ids), cols["wishes"][k].as_py(), cols["so_far"][k].as_py())
                    else:
                        best.add(products(anchors[2], v), ids, anchors[1][:, None] == labels, anchors[0][:, None] != ids)
            if best is not None:
                yield results()

        probes = map_texts(state, probe, "block long, cell int")
        pairs = probes.join(layout.select("cell", "parts"), "cell").select("block", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        nothing = [F.lit(None).cast(state.schema[c].dataType).alias(c) for c in ("wishes", "so_far")]
        work = pairs.join(index, ["cell", "part"]).select("block", F.pmod(F.xxhash64("cell", "part"), F.lit(slices_in_all)).alias("slice"),
                                                          F.lit(False).alias("anchors"), "ids", "labels", "vectors", *nothing)
        heads = state.select("block", F.explode(F.expr(f"sequence(0L, {slices_in_all - 1}L)")).alias("slice"), F.lit(True).alias("anchors"),
                             "ids", "labels", "vectors", "wishes", "so_far")
        dealt = heads.unionByName(work).repartition("block", "slice").sortWithinPartitions("block", "slice", F.desc("anchors"))
        return map_texts(dealt, score, "block long, i int, positive long, positive_score long, id long, score long", rows=64)

    def search(state: DataFrame, want_positives: bool) -> DataFrame:
        """The best rows of every wish, after both passes."""
        keep = positives if want_positives else negatives
        rank = Window.partitionBy("block", "i", "positive").orderBy(F.desc("score"), "id")
        name = "negatives-" + ("positives" if want_positives else "windows")
        ahead = stored(scored(state, want_positives, False).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= keep), name)
        grouped = ahead.groupBy("block").agg(F.collect_list(F.struct("i", "positive", "score")).alias("so_far"))
        more = scored(state.drop("so_far").join(grouped, "block", "left"), want_positives, True)
        return stored(ahead.drop("rank").unionByName(more).dropDuplicates(["block", "i", "positive", "id", "score"])
                      .withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= keep), name)

    none = asked.withColumn("wishes", F.expr("CAST(NULL AS array<struct<i:int,id:bigint,score:bigint>>)")) \
        .withColumn("so_far", F.expr("CAST(NULL AS array<struct<i:int,positive:bigint,score:bigint>>)"))
    near = search(none, True)
    wishes = near.groupBy("block").agg(F.collect_list(F.struct("i", "id", "score")).alias("wishes"))
    hard = search(none.drop("wishes").join(wishes, "block"), False)

    def name_anchors(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            for k in range(len(cols["block"])):
                ids = np.frombuffer(cols["ids"][k].as_py(), "<i8")
                yield {"block": [cols["block"][k].as_py()] * len(ids), "i": np.arange(len(ids)), "anchor_id": ids}

    named = map_texts(asked.select("block", "ids"), name_anchors, "block long, i int, anchor_id long")
    return hard.join(named, ["block", "i"]).select("anchor_id", F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                                                   F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
