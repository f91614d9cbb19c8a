"""Exact decision trees and forests: thresholds between neighbouring values, no bins, no limit of depth.

A node with many rows is split by Spark, from sums of cells of each feature and
the values of those cells that can hold the best threshold; one with at most
``local_rows`` different rows is grown to its end in a task. Both follow one rule: of the features that may split a node, the
threshold (midway between neighbouring values) with the largest decrease of
the Gini impurity; of equal ones the first feature, then the lowest threshold.
All nodes of a level, of all trees of a forest, are split in the same pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial
from hashlib import md5
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import col
from ..session import release_shuffles, stored
from .blocks import Blocks, matrix, pack, total

ROOT = 1
WAVE_ROWS = 1 << 24
UPPER = "tree int, node long, parent long, side int, depth int, feature int, threshold double, gain double, counts array<double>"
SUBTREE = "tree int, root long, parent long, side int, depth int, size int, data binary"


class Forest(NamedTuple):
    """A fitted model: ``upper`` nodes split by Spark, ``subtrees`` grown in tasks, both stored tables."""

    upper: DataFrame
    subtrees: DataFrame
    cols: list[str]
    labels: list
    trees: int
    levels: int  # of ``upper``
    ways: dict[int, list[list]]  # from each root to its leaves among ``upper`` and to its subtrees


def _waves(rows: dict[int, int]) -> Iterator[list[int]]:
    """Trees whose rows are moved at the same time: disk holds ``WAVE_ROWS`` rows, however many trees there are."""
    wave, held = [], 0
    for tree, n in rows.items():
        if wave and held + n > WAVE_ROWS:
            yield wave
            wave, held = [], 0
        wave.append(tree)
        held += n
    if wave:
        yield wave


def child(tree: int, node: int, side: int) -> int:
    """Identifier of the left (0) or right (1) child: 60 bits of a hash, so that depth has no limit."""
    return int(md5(f"{tree}:{node}:{side}".encode()).hexdigest()[:15], 16)


def feature_order(seed: int, tree: int, node: int, count: int) -> list[int]:
    """Features in the order in which a node of a forest may try them."""
    return sorted(range(count), key=lambda f: md5(f"{seed}:{tree}:{node}:{f}".encode()).hexdigest())


NODE = np.dtype([("id", "<i8"), ("parent", "<i8"), ("side", "<i4"), ("depth", "<i4"), ("feature", "<i4"), ("left", "<i4"), ("right", "<i4"),
                 ("threshold", "<f8"), ("gain", "<f8")])


def grow(x: np.ndarray, onehot: np.ndarray, tree: int, root: int, parent: int, side: int, depth: int, tries: int | None, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole subtree of a node: its nodes, level by level, and their weights by class.

    All nodes of a level are split by the same sums: ``onehot`` has weights by class, and for each feature the
    rows lie by node, then value. A level parts them, so that nothing is sorted twice.
    """
    p, classes = x.shape[1], onehot.shape[1]
    ranks, values, listed = [], [], []
    for column in x.T:
        different, rank = np.unique(column, return_inverse=True)
        values.append(different)
        ranks.append(rank.astype(np.int32))
        listed.append(np.argsort(ranks[-1].astype(np.uint16) if len(different) <= 1 << 16 else ranks[-1], kind="stable"))  # numpy sorts short integers by their digits
    levels: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    level = np.zeros(1, NODE)
    level["id"], level["parent"], level["side"] = root, parent, side
    own, sizes = onehot.sum(axis=0)[None], np.array([len(x)])
    place = 0  # of the first node of the level
    while len(level):
        level["depth"], level["feature"], level["left"], level["right"] = depth, -1, -1, -1
        levels.append(level)
        counts.append(own)
        open_ = np.count_nonzero(own, axis=1) > 1
        if not open_.all():
            keep = np.repeat(open_, sizes)
            listed = [rows[keep] for rows in listed]
        nodes, sizes, whole = np.flatnonzero(open_), sizes[open_], own[open_]
        if not len(nodes):
            break
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(np.arange(len(nodes)), sizes)  # node of each place
        may = np.column_stack([rank[rows[starts]] != rank[rows[starts + sizes - 1]] for rank, rows in zip(ranks, listed)])
        if tries is not None:
            for k, node in enumerate(nodes):
                order = [f for f in feature_order(seed, tree, int(level["id"][node]), p) if may[k, f]][:tries]
                may[k] = False
                may[k, order] = True
        best, feature = np.full(len(nodes), -np.inf), np.full(len(nodes), -1)
        threshold, lefts = np.zeros(len(nodes)), np.zeros_like(whole)
        for f in np.flatnonzero(may.any(axis=0)):
            rows, rank = listed[f], ranks[f][listed[f]]
            cuts = np.flatnonzero((rank[1:] != rank[:-1]) & (at[1:] == at[:-1]) & may[at[:-1], f])
            run = np.cumsum(onehot[rows], axis=0)
            before = run[starts] - onehot[rows[starts]]
            which = at[cuts]
            left = run[cuts] - before[which]
            right = whole[which] - left
            score = (left ** 2).sum(axis=1) / left.sum(axis=1) + (right ** 2).sum(axis=1) / right.sum(axis=1)
            heads = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            most = np.maximum.reduceat(score, heads)
            tops = np.flatnonzero(score == np.repeat(most, np.diff(np.r_[heads, len(cuts)])))
            first = tops[np.searchsorted(which[tops], which[heads])]  # the lowest threshold of equal ones
            better = most > best[which[heads]]
            k, first = which[heads][better], first[better]
            best[k], feature[k], lefts[k] = most[better], f, left[first]
            low, high = values[f][rank[cuts[first]]], values[f][rank[cuts[first] + 1]]
            middle = (low + high) / 2
            threshold[k] = np.where((low <= middle) & (middle < high), middle, low)
        split = feature >= 0
        done = nodes[split]
        place += len(level)
        level["feature"][done], level["threshold"][done] = feature[split], threshold[split]
        level["gain"][done] = best[split] - (whole[split] ** 2).sum(axis=1) / whole[split].sum(axis=1)
        level["left"][done], level["right"][done] = place + 2 * np.arange(len(done)), place + 2 * np.arange(len(done)) + 1
        goes_left = np.zeros(len(x), bool)
        for f in np.unique(feature[split]):
            rows = listed[f][(feature == f)[at]]
            goes_left[rows] = x[rows, f] <= threshold[at[(feature == f)[at]]]
        stays, rank_of = split[at], np.cumsum(split) - 1
        parent_place = rank_of[at[stays]]
        parted = []
        for rows in listed:
            rows = rows[stays]
            left = goes_left[rows]
            if not parted:
                lots = np.bincount(2 * parent_place + ~left, minlength=2 * len(done))
                begin = np.cumsum(lots) - lots
                first_row = np.flatnonzero(np.r_[True, parent_place[1:] != parent_place[:-1]]) if len(parent_place) else np.zeros(0, int)
            seen = np.cumsum(left)
            seen_before = (seen[first_row] - left[first_row])[parent_place]
            to_left = seen - seen_before - 1
            to_right = np.arange(len(rows)) - first_row[parent_place] - to_left - 1
            out = np.empty_like(rows)
            out[np.where(left, begin[2 * parent_place] + to_left, begin[2 * parent_place + 1] + to_right)] = rows
            parted.append(out)
        following = np.zeros(2 * len(done), NODE)
        following["id"] = [child(tree, ident, k) for ident in level["id"][done].tolist() for k in (0, 1)]
        following["parent"], following["side"] = np.repeat(level["id"][done], 2), np.tile([0, 1], len(done))
        own = np.stack([lefts[split], whole[split] - lefts[split]], axis=1).reshape(-1, classes)
        if not len(done):
            break
        listed, sizes, level, depth = parted, lots, following, depth + 1
    return np.concatenate(levels), np.concatenate(counts)


def between(low: float, high: float) -> float:
    """The threshold midway, or ``low`` where no number lies between."""
    middle = (low + high) / 2
    return float(middle if low <= middle < high else low)


def _score(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What the Gini impurity leaves for rows of weights by class on the left of a cut."""
    def squares(w: np.ndarray) -> np.ndarray:
        mass = w.sum(axis=-1)
        return np.divide((w ** 2).sum(axis=-1), mass, out=np.zeros(mass.shape), where=mass > 0)

    return squares(left) + squares(whole - left)


def _bounds(before: np.ndarray, own: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """No cut inside a cell scores more: the score is convex in the weights on the left, so it is largest at a corner of what they may be."""
    classes = own.shape[1]
    if classes > 6:
        return np.full(len(own), np.inf)
    corners = (np.arange(1 << classes)[:, None] >> np.arange(classes)) & 1
    return _score(before[:, None, :] + own[:, None, :] * corners, whole).max(axis=1)


def _router(nodes: dict[int, dict], wanted: set[int]) -> list[list]:
    """The way from the root to the ``wanted`` nodes: entries of bounds, feature, threshold, left and right entry, node.

    Nodes with nothing wanted on one side leave a bound, so that a row meets as many
    comparisons as there are forks, not levels.
    """
    alive: set[int] = set()
    for node in wanted:
        while node is not None and node not in alive:
            alive.add(node)
            node = nodes[node]["parent"]
    entries: list[list] = []
    waiting = [(ROOT, -1, 0)] if alive else []
    while waiting:
        node, above, side = waiting.pop()
        low: dict[int, float] = {}
        high: dict[int, float] = {}
        while node not in wanted:
            f, t, kids = nodes[node]["feature"], nodes[node]["threshold"], nodes[node]["kids"]
            if kids[0] in alive and kids[1] in alive:
                break
            if kids[0] in alive:
                high[f] = min(t, high.get(f, t))
            else:
                low[f] = max(t, low.get(f, t))
            node = kids[0] if kids[0] in alive else kids[1]
        place = len(entries)
        if above >= 0:
            entries[above][3 + side] = place
        bounds = [(f, low.get(f), high.get(f)) for f in sorted({*low, *high})]
        if node in wanted:
            entries.append([bounds, -1, 0.0, -1, -1, node])
        else:
            entries.append([bounds, nodes[node]["feature"], nodes[node]["threshold"], -1, -1, None])
            waiting += [(nodes[node]["kids"][1], place, 1), (nodes[node]["kids"][0], place, 0)]
    return entries


def _routed(entries: list[list], columns: Sequence[np.ndarray], rows: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes that some of the ``rows`` reach (all, unless given), and these rows."""
    waiting = [(0, rows)] if entries else []
    while waiting:
        place, own = waiting.pop()
        bounds, feature, threshold, left, right, node = entries[place]
        for f, low, high in bounds:
            x = columns[f] if own is None else columns[f][own]
            if low is None:
                kept = x <= high
            else:
                kept = x > low if high is None else (x > low) & (x <= high)
            own = np.flatnonzero(kept) if own is None else own[kept]
        if own is None:
            own = np.arange(len(columns[0]))
        if not len(own):
            continue
        if node is not None:
            yield node, own
            continue
        goes_left = columns[feature][own] <= threshold
        waiting += [(right, own[~goes_left]), (left, own[goes_left])]


class _Rows(NamedTuple):
    """How the rows of packed blocks are read: ``p`` features, class and number; bootstrap weights are drawn per block."""

    p: int
    classes: int
    trees: int | None
    seed: int

    def of(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, Callable[[int], np.ndarray]]:
        parts = [(block, matrix(data.as_buffer(), self.p + 1)) for block, data in zip(batch.column("block").to_pylist(), batch.column("data"))]
        m = np.concatenate([part for _, part in parts]) if parts else np.zeros((0, self.p + 2))

        def weights(tree: int) -> np.ndarray:
            if self.trees is None:
                return m[:, -1]
            return np.concatenate([np.random.default_rng([self.seed, tree, block]).poisson(part[:, -1]) for block, part in parts]).astype(np.float64)

        return np.asfortranarray(m[:, :self.p]), m[:, self.p].astype(int), weights

    def of_cells(self, batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, Callable[[int], np.ndarray | None]]:
        """All rows of a task that reads ``_Cells``: values and cells of each feature, class, and weights of a tree (none where all are 1)."""
        x, cells, y, m, blocks = [], [], [], [], []
        for batch in batches:
            for block, n, *data in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "x", "cells", "y", "m")]):
                if n:
                    blocks.append(block)
                    for out, part, kind in zip((x, cells, y, m), data, ("<f8", "<u2", "<i4", "<f8")):
                        out.append(np.frombuffer(part, kind).reshape(-1, n))
        single = all((part == 1).all() for part in m)

        def weights(tree: int) -> np.ndarray | None:
            if self.trees is None:
                return None if single else np.concatenate([part[0] for part in m])
            return np.concatenate([np.random.default_rng([self.seed, tree, block]).poisson(part[0]) for block, part in zip(blocks, m)]).astype(np.float64)

        if not blocks:
            return [], [], np.zeros(0, int), weights
        return ([np.concatenate([part[f] for part in x]) for f in range(self.p)], [np.concatenate([part[f] for part in cells]) for f in range(self.p)],
                np.concatenate([part[0] for part in y]), weights)


class _Cells(NamedTuple):
    """Packed rows by feature, with the cell of each value: ``frame`` (block, n, x, cells, y, m), borders of the cells, the value of those with one (NaN in others)."""

    frame: DataFrame
    borders: list[np.ndarray]
    alone: list[np.ndarray]
    rows: int
    parts: int


def _celled(blocks: Blocks, rows: _Rows, borders: list[np.ndarray]) -> _Cells:
    p = rows.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                m = matrix(data.as_buffer(), p + 1)
                cells = np.stack([np.searchsorted(b, m[:, f]) for f, b in enumerate(borders)])
                out.append((block, len(m), m[:, :p].T.tobytes(), cells.astype("<u2").tobytes(), m[:, p].astype("<i4").tobytes(), m[:, p + 1].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=["block", "n", "x", "cells", "y", "m"])

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    frame = blocks.frame.select("block", "data").mapInArrow(run, "block long, n int, x binary, cells binary, y binary, m binary").persist()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, cells, _, _ = rows.of_cells(batches)
        for f in range(len(x)):
            order = np.argsort(cells[f], kind="stable")
            cell, value = cells[f][order], x[f][order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            low, high = np.full(len(borders[f]) + 1, np.inf), np.full(len(borders[f]) + 1, -np.inf)
            low[cell[starts]], high[cell[starts]] = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([low.tobytes()]), pa.array([high.tobytes()])], names=["feature", "low", "high"])

    def widest(group: pa.Table) -> pa.Table:
        low = np.min([np.frombuffer(v) for v in group.column("low").to_pylist()], axis=0)
        high = np.max([np.frombuffer(v) for v in group.column("high").to_pylist()], axis=0)
        return pa.table({"feature": group.column("feature")[:1].cast(pa.int32()), "value": pa.array([np.where(low == high, low, np.nan).tobytes()])})

    found = frame.mapInArrow(spans, "feature int, low binary, high binary").groupBy("feature").applyInArrow(widest, "feature int, value binary").collect()
    alone = {r["feature"]: np.frombuffer(r["value"]) for r in found}
    return _Cells(frame, borders, [alone[f] for f in range(p)], int(frame.agg(F.sum("n")).first()[0]), frame.rdd.getNumPartitions())


def _thinned(held: _Cells, rows: _Rows, entries: list[list], left: int) -> _Cells:
    """The rows that still have to be split, where weights aren't drawn from whole blocks."""
    p = rows.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, n, *data in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "x", "cells", "y", "m")]):
                parts = [np.frombuffer(part, kind).reshape(-1, n) for part, kind in zip(data, ("<f8", "<u2", "<i4", "<f8"))]
                own = np.sort(np.concatenate([np.zeros(0, int), *[own for _, own in _routed(entries, parts[0], None)]])) if n else np.zeros(0, int)
                if len(own):
                    out.append((block, len(own), *[part[:, own].tobytes() for part in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=batch.schema.names)

    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    frame = stored(held.frame.mapInArrow(run, held.frame.schema), "tree-cells").persist()
    frame.count()
    held.frame.unpersist()
    return held._replace(frame=frame, rows=left)


def _sums(keys: np.ndarray, values: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per different key: the key, smallest and largest value, and weights by class with the number of rows behind them."""
    order = np.lexsort((values, keys))
    keys, values, y, w = keys[order], values[order], y[order], w[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    place = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    sums = np.bincount(place * classes + y, weights=w, minlength=len(starts) * classes).reshape(-1, classes)
    number = np.diff(np.r_[starts, len(keys)])
    return keys[starts], values[starts], values[np.r_[starts[1:], len(keys)] - 1], np.column_stack([sums, number])


def _split_large(held: _Cells, rows: _Rows, routers: dict[int, list[list]], tries: int | None) -> dict[tuple[int, int], dict]:
    """Exact best split of every (tree, node) that the routers lead to: feature, threshold, score, sums on the left and in all; feature None without a split.

    A first read adds up every cell of every node, in arrays of a task: all cuts between cells have
    their score then, and those inside a cell a bound. A second read looks at the cells whose bound reaches the best
    score, value by value, a cell in one task, and at both sides of the best cut, for its threshold. So neither a node nor a
    feature has to fit a task.
    """
    p, classes, borders, alone = rows.p, rows.classes, held.borders, held.alone
    names = [f"c{k}" for k in range(classes)]

    def reached(entries: list[list], x: list[np.ndarray], w: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        return _routed(entries, x, None if w is None or (w > 0).all() else np.flatnonzero(w > 0)) if x else iter(())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, cells, y, weights = rows.of_cells(batches)
        for tree, entries in routers.items():
            w = weights(tree)
            for node, own in reached(entries, x, w):
                label, mass = y[own], None if w is None else w[own]
                out = []
                for f in range(p):
                    code, number = cells[f][own].astype(np.int64), len(borders[f]) + 1
                    if len(own) < number // 4:  # few of the cells are met
                        met, code = np.unique(code, return_inverse=True)
                        number = len(met)
                    else:
                        met = None
                    sums = np.bincount(code * classes + label, weights=mass, minlength=number * classes).reshape(-1, classes)
                    n = sums.sum(axis=1) if mass is None else np.bincount(code, minlength=number)
                    some = np.flatnonzero(n)
                    if len(some) == 1:
                        low, high = float(x[f][own].min()), float(x[f][own].max())
                    else:
                        low, high = -np.inf, np.inf
                    out.append((tree, node, f, low, high, (some if met is None else met).astype("<i4").tobytes(), np.column_stack([sums, n])[some].astype("<f8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["tree", "node", "feature", "low", "high", "cells", "sums"])

    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]

    def judge(group: pa.Table) -> pa.Table:
        f = group.column("feature")[0].as_py()
        parts = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f8").reshape(-1, classes + 1)) for c, v in zip(group.column("cells").to_pylist(), group.column("sums").to_pylist())]
        sums = np.zeros((len(borders[f]) + 1, classes + 1))
        for cell, part in parts:  # a task names a cell once
            sums[cell] += part
        cell = np.flatnonzero(sums[:, -1])
        sums = sums[cell]
        left = np.cumsum(sums, axis=0)
        whole, before = left[-1], left - sums
        score, at = np.full(len(left), -np.inf), -1
        if len(left) > 1:
            score[:-1] = _score(left[:-1, :classes], whole[:classes])
            at = int(score.argmax())
        varies = len(left) > 1 or min(group.column("low").to_pylist()) < max(group.column("high").to_pylist())
        inner = np.isnan(alone[f][cell]) & (sums[:, -1] > 1) & varies
        bound = np.full(len(left), -np.inf)
        bound[inner] = _bounds(before[inner, :classes], sums[inner, :classes], whole[:classes])
        open_ = np.flatnonzero(inner & (bound >= score.max() * (1 - 1e-12) if at >= 0 else True))
        return pa.Table.from_pylist([{
            "tree": group.column("tree")[0].as_py(), "node": group.column("node")[0].as_py(), "feature": f, "varies": varies,
            "score": float(score[at]) if at >= 0 else None, "sides": cell[at:at + 2].tolist() if at >= 0 else None,
            "lefts": left[at].tolist() if at >= 0 else None, "whole": whole.tolist(), "cells": cell[open_].tolist(),
            "bounds": bound[open_].tolist(), "before": before[open_].ravel().tolist()}], schema=judged)

    judged = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("varies", pa.bool_()), ("score", pa.float64()),
                        ("sides", pa.list_(pa.int32())), ("lefts", pa.list_(pa.float64())), ("whole", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())),
                        ("bounds", pa.list_(pa.float64())), ("before", pa.list_(pa.float64()))])
    own_sums = ", ".join(f"{c} double" for c in (*names, "n"))
    found = held.frame.mapInArrow(scan, "tree int, node long, feature int, low double, high double, cells binary, sums binary").groupBy(
        "tree", "node", "feature").applyInArrow(judge, "tree int, node long, feature int, varies boolean, score double, sides array<int>, "
                                                       "lefts array<double>, whole array<double>, cells array<int>, bounds array<double>, before array<double>").collect()
    listed: dict[tuple[int, int], list] = {}
    for r in found:
        listed.setdefault((r["tree"], r["node"]), []).append(r)
    best: dict[tuple[int, int], dict] = {}
    looks: dict[tuple[int, int, int], dict[int, list[float]]] = {}  # cells to look into, with what stands before them
    sides: dict[tuple[int, int, int], list[int]] = {}  # cells on both sides of the best cut between cells
    ends: dict[tuple[int, int, int], list[float]] = {}  # the values there
    for (tree, node), by_feature in listed.items():
        varying = {r["feature"]: r for r in by_feature if r["varies"]}
        chosen = list(varying) if tries is None else [f for f in feature_order(rows.seed, tree, node, p) if f in varying][:tries]
        top, f = min(((-varying[f]["score"], f) for f in chosen if varying[f]["score"] is not None), default=(np.inf, None))
        best[tree, node] = {"top": (top, f), "lefts": None if f is None else varying[f]["lefts"], "inside": [], "whole": by_feature[0]["whole"]}
        if f is not None:
            cells = varying[f]["sides"]
            sides[tree, node, f], ends[tree, node, f] = cells, [float(v) for v in alone[f][cells]]
        for f in chosen:
            r = varying[f]
            for k, (cell, bound) in enumerate(zip(r["cells"], r["bounds"])):
                if bound >= -top * (1 - 1e-12) or top == np.inf:
                    looks.setdefault((tree, node, f), {})[cell] = r["before"][k * (classes + 1):(k + 1) * (classes + 1)]
    asked: dict[tuple[int, int, int], set[int]] = {key: set(cells) for key, cells in looks.items()}
    for key, values in ends.items():
        unknown = {cell for cell, value in zip(sides[key], values) if np.isnan(value)}
        if unknown:
            asked[key] = asked.get(key, set()) | unknown
    if asked:
        wholes = {(tree, node): np.array(best[tree, node]["whole"]) for tree, node, _ in asked}

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, cells, y, weights = rows.of_cells(batches)
            wanted = {}
            for (tree, node, f), listed_ in asked.items():
                mark = np.zeros(len(borders[f]) + 1, bool)
                mark[list(listed_)] = True
                wanted.setdefault((tree, node), []).append((f, mark))
            for tree in sorted({tree for tree, _ in wanted}):
                w = weights(tree)
                for node, own in reached(routers[tree], x, w):
                    for f, mark in wanted.get((tree, node), ()):
                        rows_ = own[mark[cells[f][own]]]
                        if not len(rows_):
                            continue
                        value, _, _, sums = _sums(x[f][rows_], x[f][rows_], y[rows_], np.ones(len(rows_)) if w is None else w[rows_], classes)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), v), t) for v, t in ((tree, pa.int32()), (node, pa.int64()), (f, pa.int32()))]
                                                         + [pa.array(np.searchsorted(borders[f], value), pa.int32()), pa.array(value), *[pa.array(c) for c in sums.T]],
                                                         names=["tree", "node", "feature", "cell", "value", *names, "n"])

        def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held_ = [batch for batch in batches if batch.num_rows]
            if not held_:
                return
            table = pa.Table.from_batches(held_)
            columns = {c: table.column(c).to_numpy() for c in table.column_names}
            keys = ("tree", "node", "feature", "cell")
            order = np.lexsort((columns["value"], *[columns[c] for c in reversed(keys)]))
            columns = {c: v[order] for c, v in columns.items()}
            value = columns["value"]
            new = np.r_[True, np.any([columns[c][1:] != columns[c][:-1] for c in keys], axis=0)]
            starts = np.flatnonzero(new | np.r_[True, value[1:] != value[:-1]])  # of different values
            sums = np.add.reduceat(np.column_stack([columns[c] for c in (*names, "n")]), starts, axis=0)
            value, heads = value[starts], np.flatnonzero(new[starts])  # of cells among them
            ends_ = np.r_[heads[1:], len(value)] - 1
            found_ = [tuple(int(columns[c][k]) for c in keys) for k in starts[heads]]
            out = [{"tree": t, "node": n, "feature": f, "cell": c, "low": float(value[i]), "high": float(value[j])} for (t, n, f, c), i, j in zip(found_, heads, ends_)]
            whole = np.array([wholes[t, n] for t, n, _, _ in found_])
            before = np.array([looks.get((t, n, f), {}).get(c, [np.nan] * (classes + 1)) for t, n, f, c in found_])
            at = np.repeat(np.arange(len(heads)), ends_ - heads + 1)
            run = np.cumsum(sums, axis=0)
            left = run - (run[heads] - sums[heads] - before)[at]
            inner = np.flatnonzero((at == np.r_[at[1:], -1]) & ~np.isnan(left[:, -1]))
            if len(inner):
                score, which = _score(left[inner, :classes], whole[at[inner], :classes]), at[inner]
                first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
                most = np.maximum.reduceat(score, first)
                tops = np.flatnonzero(score == np.repeat(most, np.diff(np.r_[first, len(which)])))
                for k in tops[np.searchsorted(which[tops], which[first])]:  # the lowest threshold of equal ones
                    row = inner[k]
                    out[which[k]] |= {"score": float(score[k]), "threshold": between(float(value[row]), float(value[row + 1])), "lefts": left[row].tolist()}
            yield from pa.Table.from_pylist(out, schema=refined).to_batches()

        refined = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()),
                             ("score", pa.float64()), ("threshold", pa.float64()), ("lefts", pa.list_(pa.float64()))])
        picked = held.frame.mapInArrow(pick, f"tree int, node long, feature int, cell int, value double, {own_sums}")
        for r in picked.repartition(held.parts, "tree", "node", "feature", "cell").mapInArrow(
                inside, "tree int, node long, feature int, cell int, low double, high double, score double, threshold double, lefts array<double>").collect():
            key = r["tree"], r["node"], r["feature"]
            if key in sides and r["cell"] in sides[key]:
                side = sides[key].index(r["cell"])
                ends[key][side] = r["low"] if side else r["high"]
            if r["score"] is not None:
                best[r["tree"], r["node"]]["inside"].append((-r["score"], r["feature"], r["threshold"], r["lefts"]))
    out = {}
    for (tree, node), own in best.items():
        score, f = own["top"]
        cuts = own["inside"] + ([] if f is None else [(score, f, between(*ends[tree, node, f]), own["lefts"])])
        score, f, threshold, lefts = min(cuts, default=(np.inf, None, None, None))
        out[tree, node] = {"feature": f, "threshold": threshold, "score": -score, "lefts": lefts, "whole": own["whole"]}
    return out


def _borders(blocks: Blocks, p: int, seed: int) -> list[np.ndarray]:
    """Borders of cells per feature, from the values of a few blocks, which hold hashed rows: they decide how much is looked at twice, not what is found."""
    cells = min(1 << 16, max(512, 8 * blocks.count))
    parts = blocks.frame.orderBy(F.xxhash64(F.lit(seed), "block"), "block").limit(160).select("data").collect()
    sample = np.concatenate([matrix(r["data"], p + 1) for r in parts])
    return [np.unique(np.quantile(sample[:, f], np.linspace(0, 1, cells + 1)[1:-1], method="lower")) for f in range(p)]


def fit(train: DataFrame, cols: Sequence[str], label: str, *, trees: int | None = None, tries: int | None = None, seed: int = 0,
        local_rows: int = 65536) -> Forest:
    """One tree on all rows, or a forest of ``trees`` on Poisson bootstraps with ``tries`` varying features a node.

    Leaves are pure, or have no feature that varies; without rows there are no
    nodes, and predictions are null. Rows with a null or
    not-a-number in a column, or a null label, are left out; equal rows count by
    their number. The bootstrap weight of a row is drawn from its block, so
    neither partitions nor retries change a tree.
    """
    cols, p = list(cols), len(cols)
    labels = sorted(r[0] for r in train.select(col(label)).distinct().collect() if r[0] is not None)  # one per class
    classes = max(1, len(labels))
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), col(label)) - 1 if labels else F.lit(None)
    known = train.filter(col(label).isNotNull())
    blocks = pack(known, {**{f"x{k}": col(c) for k, c in enumerate(cols)}, "y": code}, name="tree-rows").cache()
    try:
        return _fit(blocks, _Rows(p, classes, trees, seed), cols, labels, tries, local_rows)
    finally:
        blocks.close()


def _fit(blocks: Blocks, rows: _Rows, cols: list[str], labels: list, tries: int | None, local_rows: int) -> Forest:
    spark, (p, classes, trees, seed) = blocks.frame.sparkSession, rows
    numbers = range(trees or 1)

    def weigh(m: np.ndarray, block: int) -> np.ndarray:
        out = []
        for tree in numbers:
            w = m[:, -1] if trees is None else np.random.default_rng([seed, tree, block]).poisson(m[:, -1])
            out.append([*np.bincount(m[:, p].astype(int), weights=w, minlength=classes), np.count_nonzero(w)])
        return np.concatenate(out)

    roots = np.rint(total(blocks, weigh, len(numbers) * (classes + 1))).reshape(len(numbers), -1)
    forest: list[dict[int, dict]] = [{} for _ in numbers]  # nodes above ``local_rows`` and their children
    frontier: list[tuple[int, int]] = []

    def add(tree: int, node: int, parent: int | None, side: int | None, depth: int, sums: Sequence[float]) -> None:
        if sums[-1] > 0:
            forest[tree][node] = {"parent": parent, "side": side, "depth": depth, "counts": [float(c) for c in sums[:-1]], "n": int(sums[-1]),
                                  "feature": None, "threshold": None, "gain": None, "kids": None}
            if sums[-1] > local_rows and np.count_nonzero(sums[:-1]) > 1:
                frontier.append((tree, node))

    for tree in numbers:
        add(tree, ROOT, None, None, 0, roots[tree])
    held = _celled(blocks, rows, _borders(blocks, p, seed)) if frontier else None
    levels = 0
    while frontier:
        levels += 1
        wanted: dict[int, set[int]] = {}
        for tree, node in frontier:
            wanted.setdefault(tree, set()).add(node)
        frontier.clear()
        routers = {tree: _router(forest[tree], own) for tree, own in wanted.items()}
        if trees is None and 2 * (left := sum(forest[0][node]["n"] for node in wanted[0])) < held.rows:
            held = _thinned(held, rows, routers[0], left)
        found = _split_large(held, rows, routers, tries)
        for (tree, node), s in sorted(found.items()):
            if s["feature"] is None:
                continue
            own, left, whole = forest[tree][node], np.array(s["lefts"]), np.array(s["whole"])
            own |= {"feature": s["feature"], "threshold": s["threshold"], "gain": s["score"] - float((whole[:-1] ** 2).sum() / whole[:-1].sum()),
                    "kids": [child(tree, node, 0), child(tree, node, 1)]}
            for side, sums in enumerate((left, whole - left)):
                add(tree, own["kids"][side], node, side, own["depth"] + 1, sums)
    if held is not None:
        held.frame.unpersist()
    small = [{node for node, own in nodes.items() if own["n"] <= local_rows} for nodes in forest]
    upper = [(tree, node, own["parent"], own["side"], own["depth"], own["feature"], own["threshold"], own["gain"], own["counts"])
             for tree, nodes in enumerate(forest) for node, own in nodes.items() if own["n"] > local_rows]
    down = {tree: _router(forest[tree], own) for tree, own in enumerate(small) if own}
    places = {tree: {node: (nodes[node]["parent"], nodes[node]["side"], nodes[node]["depth"]) for node in small[tree]} for tree, nodes in enumerate(forest)}

    def deal(own_trees: dict[int, list[list]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, weights = rows.of(batch)
            for tree, entries in own_trees.items():
                w, out = weights(tree), []
                for node, own in _routed(entries, x.T, np.flatnonzero(w > 0)):
                    data = np.column_stack([x[own], y[own], w[own]]).astype("<f8").tobytes()
                    out.append((tree, node, *places[tree][node], batch.column("block")[0].as_py(), data))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["tree", "node", "parent", "side", "depth", "block", "data"])

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        key = None

        def done() -> pa.RecordBatch:
            m = np.concatenate(held)
            onehot = np.zeros((len(m), classes))
            onehot[np.arange(len(m)), m[:, p].astype(int)] = m[:, -1]
            tree, root, parent, side, depth = key
            nodes, counts = grow(m[:, :p], onehot, tree, root, -1 if parent is None else parent, -1 if side is None else side, depth, tries, seed)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(
                (tree, root, parent, side, depth, len(nodes), nodes.tobytes() + counts.astype("<f8").tobytes()),
                (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))],
                names=["tree", "root", "parent", "side", "depth", "size", "data"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "node", "parent", "side", "depth", "data")]
            for *own, data in zip(*columns):
                if key is not None and own != key:
                    yield done()
                    held = []
                key = own
                held.append(matrix(data, p + 1))
        if held:
            yield done()

    subtrees = None
    for wave in _waves({tree: sum(forest[tree][node]["n"] for node in small[tree]) for tree in down}):
        ready = blocks.frame.select("block", "data").mapInArrow(partial(deal, {tree: down[tree] for tree in wave}),
                                                                "tree int, node long, parent long, side int, depth int, block long, data binary")
        tasks = min(1000, max(1, sum(len(small[tree]) for tree in wave)))
        grown = stored(ready.repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node", "block").mapInArrow(finish, SUBTREE), "subtrees")
        subtrees = grown if subtrees is None else subtrees.unionByName(grown)
        ready = None
        release_shuffles(spark)
    if subtrees is None:
        subtrees = stored(spark.createDataFrame([], SUBTREE), "subtrees")
    ends = {tree: _router(nodes, {node for node, own in nodes.items() if own["feature"] is None}) for tree, nodes in enumerate(forest)}
    return Forest(stored(spark.createDataFrame(upper, UPPER), "upper-nodes"), subtrees, cols, labels or [None], trees or 1, levels, ends)


def _unpacked(data: bytes, size: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    cut = size * NODE.itemsize
    return np.frombuffer(data[:cut], NODE), np.frombuffer(data[cut:], "<f8").reshape(size, classes)


def node_table(model: Forest) -> DataFrame:
    """All nodes as rows: ``UPPER`` with null ``feature``, ``threshold`` and ``gain`` in leaves and null ``parent`` in roots."""
    classes = max(1, len(model.labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, size, data in zip(*[batch.column(c).to_pylist() for c in ("tree", "size", "data")]):
                nodes, counts = _unpacked(data, size, classes)
                leaf = nodes["feature"] < 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, tree), pa.int32()), pa.array(nodes["id"]), pa.array(nodes["parent"], mask=nodes["parent"] < 0),
                    pa.array(nodes["side"], mask=nodes["side"] < 0), pa.array(nodes["depth"]), pa.array(nodes["feature"], mask=leaf),
                    pa.array(nodes["threshold"], mask=leaf), pa.array(nodes["gain"], mask=leaf), pa.array(counts.tolist(), pa.list_(pa.float64()))],
                    names=["tree", "node", "parent", "side", "depth", "feature", "threshold", "gain", "counts"])

    return model.upper.unionByName(model.subtrees.select("tree", "size", "data").mapInArrow(run, UPPER))


def class_of(model: Forest, counts: Column) -> Column:
    """The class with the most weight, the first of equal ones."""
    return F.array(*[F.lit(x) for x in model.labels])[F.array_position(counts, F.array_max(counts)).cast("int") - 1]


def predict(model: Forest, df: DataFrame, name: str = "prediction", slice_rows: int = 65536) -> DataFrame:
    """Rows with the class whose share of the leaf, averaged over the trees, is largest; null where a feature is.

    A prediction depends on the features alone, so each different vector is sent
    through the trees once: through the nodes that Spark split, which every task
    holds, then to its subtree. A subtree meets its vectors in slices of about
    ``slice_rows``, and is copied once for each of its own slices. Trees go in waves, after which only the sum of a
    vector's shares is kept.
    """
    classes = max(1, len(model.labels))
    spark = df.sparkSession
    wide = F.array(*[col(c).cast("double") for c in model.cols])
    keyed = df.withColumn("_x", F.when(F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v)), wide))
    distinct = stored(keyed.select(F.col("_x").alias("x")).filter("x IS NOT NULL").distinct(), "tree-values")
    vectors = stored(distinct.select(F.monotonically_increasing_id().alias("id"), "x"), "tree-vectors")  # numbered as they lie in files
    number = vectors.count()
    release_shuffles(spark)

    def reached(ways: dict[int, list[list]], batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        columns = np.ascontiguousarray(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).T)
        for tree, entries in ways.items():
            for node, own in _routed(entries, columns, None):
                yield tree, node, own

    def count(ways: dict[int, list[list]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[int, int], int] = {}
        for batch in batches:
            for tree, node, own in reached(ways, batch) if batch.num_rows else ():
                met[tree, node] = met.get((tree, node), 0) + len(own)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in met], pa.int32()), pa.array([n for _, n in met], pa.int64()), pa.array(list(met.values()), pa.int64())],
                                         names=["tree", "root", "n"])

    def descend(ways: dict[int, list[list]], slices: dict[tuple[int, int], int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, node, own in reached(ways, batch) if batch.num_rows else ():
                ids, x = batch.column("id").take(pa.array(own)), batch.column("x").take(pa.array(own))
                lot = (ids.to_numpy() * -7046029254386353131 >> 33) % slices[tree, node]  # a hash of the number
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), tree), pa.int32()), pa.array(np.full(len(own), node), pa.int64()),
                                                  pa.array(lot, pa.int32()), ids, x], names=["tree", "root", "slice", "id", "x"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A leaf that Spark split off, as a subtree of one node."""
        node = np.zeros(1, NODE)
        node["feature"] = -1
        for batch in batches:
            data = [node.tobytes() + np.array(c, "<f8").tobytes() for c in batch.column("counts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("node"), pa.array(np.ones(len(data)), pa.int32()), pa.array(data, pa.binary())],
                                             names=["tree", "root", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = counts = None
        for batch in batches:
            sizes = batch.column("size").to_pylist()
            heads = [k for k, s in enumerate(sizes) if s is not None]
            for begin, end in zip([-1, *heads], [*heads, len(sizes)]):
                if begin >= 0:
                    nodes, counts = _unpacked(batch.column("data")[begin].as_py(), sizes[begin], classes)
                part = batch.column("x").slice(begin + 1, end - begin - 1)
                if not len(part) or nodes is None:  # a model without rows has no leaf
                    continue
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                place = np.zeros(len(part), np.int64)
                moving = np.arange(len(part))
                while True:
                    moving = moving[nodes["feature"][place[moving]] >= 0]
                    if not len(moving):
                        break
                    here = place[moving]
                    left = x[moving, nodes["feature"][here]] <= nodes["threshold"][here]
                    place[moving] = np.where(left, nodes["left"][here], nodes["right"][here])
                weights = pa.ListArray.from_arrays(pa.array(np.arange(0, classes * len(part) + 1, classes), pa.int32()), pa.array(counts[place].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(begin + 1, end - begin - 1), weights], names=["id", "counts"])

    none = [F.lit(None).cast("int").alias("size"), F.lit(None).cast("binary").alias("data")]
    mass = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b)
    ends = model.subtrees.select("tree", "root", "size", "data")
    if model.levels:
        leaf = model.upper.filter("feature IS NULL").select("tree", "node", "counts")
        ends = ends.unionByName(leaf.mapInArrow(single, "tree int, root long, size int, data binary"))
    sums = None
    for wave in _waves({tree: number for tree in model.ways}):
        ways = {tree: model.ways[tree] for tree in wave}
        met = vectors.mapInArrow(partial(count, ways), "tree int, root long, n long").groupBy("tree", "root").agg(F.sum("n").alias("n")).collect()  # one row per subtree
        slices = {(r["tree"], r["root"]): -(-r["n"] // slice_rows) for r in met}
        lots = spark.createDataFrame([(*key, n) for key, n in slices.items()], "tree int, root long, slices int")
        heads = ends.join(lots, ["tree", "root"]).select("tree", "root", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                                                         F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("x"), "size", "data")
        work = vectors.mapInArrow(partial(descend, ways, slices), "tree int, root long, slice int, id long, x array<double>").select(
            "tree", "root", "slice", "id", "x", *none)
        tasks = min(2000, max(sum(slices.values()), spark.sparkContext.defaultParallelism))
        dealt = heads.unionByName(work).repartition(tasks, "tree", "root", "slice").sortWithinPartitions("tree", "root", "slice", F.col("size").isNull())
        leaves = dealt.select("id", "x", "size", "data").mapInArrow(run, "id long, counts array<double>")
        shares = leaves.select("id", *[(F.col("counts")[k] / mass).alias(f"s{k}") for k in range(classes)])
        if model.trees > 1:
            more = shares if sums is None else shares.unionByName(sums)
            shares = more.groupBy("id").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(classes)])
        sums = stored(shares, "tree-shares")
        heads = work = dealt = leaves = shares = more = None
        release_shuffles(spark)
    mean = F.array(*[F.round(F.col(f"s{k}") / model.trees, 12) for k in range(classes)])
    answers = stored(sums.select("id", mean.alias("shares")).join(vectors, "id").select(F.col("x").alias("_x"), class_of(model, F.col("shares")).alias(name)), "tree-answers")
    return keyed.drop(name).join(answers, "_x", "left").drop("_x")


def importances(model: Forest) -> DataFrame:
    """Share of each feature in the impurity decrease of a tree, averaged over the trees that split at all."""
    gains = node_table(model).filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
    shares = gains.withColumn("share", F.col("gain") / F.sum("gain").over(W.partitionBy("tree")))
    split = shares.select("tree").distinct().agg(F.count(F.lit(1))).scalar()
    names = model.subtrees.sparkSession.createDataFrame(list(enumerate(model.cols)), "feature int, name string")
    found = shares.groupBy("feature").agg(F.sum("share").alias("share"))
    return names.join(found, "feature", "left").select(F.col("name").alias("feature"), F.coalesce(F.col("share") / split, F.lit(0.0)).alias("importance"))


def rules(model: Forest, depth: int = 3, tree: int = 0) -> DataFrame:
    """The top of a tree as rows: node (1 at the root, 2 n and 2 n + 1 below n), parent, depth, feature, threshold, class and weights by class."""
    table = node_table(model).filter((F.col("tree") == tree) & (F.col("depth") <= depth))
    level = table.filter("parent IS NULL").withColumn("number", F.lit(1))
    out = level
    for _ in range(depth):
        above = level.select(F.col("node").alias("parent"), F.col("number").alias("_above"))
        level = table.join(above, "parent").withColumn("number", F.col("_above") * 2 + F.col("side")).drop("_above")
        out = out.unionByName(level)
    names = F.array(*[F.lit(c) for c in model.cols])
    return out.select(F.col("number").alias("node"), F.when(F.col("number") > 1, F.floor(F.col("number") / 2).cast("int")).alias("parent"), "depth",
                      F.when(F.col("feature").isNotNull(), names[F.col("feature")]).alias("feature"), "threshold", class_of(model, F.col("counts")).alias("class"), "counts")
