"""Near-duplicate documents by SimHash and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, map_texts, order_id, stored, text_key
from .components import components

BITS = 64
BLOCKS = 4  # one more than the error budget: of four blocks one is equal when three bits differ
BLOCK_BITS = BITS // BLOCKS
BUDGET = 3
STEP = 8  # levels by which a crowded pair of nodes is taken apart at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text: A-Z lowered, words between ASCII white space, XXH64 with seed 42 of every run of three words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    last = ends[shingle - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip([0, *(e + 1 for e in ends)], last)]
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 65536):
        part = np.array(hashes[begin:begin + 65536], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, k, h, fp)``: identifier, its sort key, the text's key and the fingerprint as a signed long. A null text has no words."""
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            values = np.array([fingerprint(t) for t in as_bytes(part["t"])], np.uint64).view(np.int64)
            yield {"doc_id": part["d"], "k": part["k"], "h": part["h"], "fp": pa.array(values)}

    rows = docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t"), order_id(ident).alias("k"), text_key(text).alias("h"))
    return map_texts(rows, run, "doc_id long, k long, h long, fp long")


# The join of one batch of tries, in numpy

def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``(i, j)``."""
    parent = np.arange(n)
    while True:
        a, b = parent[i], parent[j]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up


def trie_links(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, err: np.ndarray, depth: int,
               budget: int = BUDGET, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices of ``keys`` that differ in at most ``budget`` bits, found by walking pairs of trie nodes together.

    A node at ``depth`` is a range of keys that is sorted and shares the first
    ``depth`` bits. The pairs given are ``[lo, hi) x [lo2, hi2)`` with ``err``
    differing bits so far (a node may be paired with itself). A pair of nodes
    goes on as its pairs of children, with one more error where the bits
    differ, and ends when the budget is exceeded or when both nodes hold one
    key. Pairs that wait for their turn are kept in pieces of ``most``.
    """
    stack = [(depth, lo, hi, lo2, hi2, err)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        depth, lo, hi, lo2, hi2, err = stack.pop()
        if len(lo) > most:
            stack += [(depth, *(x[at:at + most] for x in (lo, hi, lo2, hi2, err))) for at in range(0, len(lo), most)]
            continue
        one = (hi - lo == 1) & (hi2 - lo2 == 1)
        if one.any():
            a, b = lo[one], lo2[one]
            near = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
            yield a[near], b[near]
            lo, hi, lo2, hi2, err = (x[~one] for x in (lo, hi, lo2, hi2, err))
        if not len(lo):
            continue
        if depth not in zeros:
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate([[0], np.cumsum(1 - bit.astype(np.int64))])
        z = zeros[depth]
        mid, mid2 = lo + z[hi] - z[lo], lo2 + z[hi2] - z[lo2]
        other = lo != lo2
        children = [(lo, mid, lo2, mid2, err), (mid, hi, mid2, hi2, err), (lo, mid, mid2, hi2, err + 1),
                    tuple(x[other] for x in (mid, hi, lo2, mid2, err + 1))]
        lo, hi, lo2, hi2, err = (np.concatenate(x) for x in zip(*children))
        alive = (hi > lo) & (hi2 > lo2) & (err <= budget) & ~((lo == lo2) & (hi - lo == 1))
        if alive.any():
            stack.append((depth + 1, *(x[alive] for x in (lo, hi, lo2, hi2, err))))


def spanning_links(keys: np.ndarray, *nodes) -> tuple[np.ndarray, np.ndarray]:
    """The links of ``trie_links`` as a spanning forest: at most one per key, whatever the number of near pairs."""
    start = np.arange(len(keys))
    parent, waiting, size = start, [], 0
    for a, b in trie_links(keys, *nodes):
        waiting.append((a, b))
        size += len(a)
        if size > 1 << 21:
            parent, size = forest(len(keys), *(np.concatenate(x) for x in zip((start, parent), *waiting))), 0
            waiting = []
    if waiting:
        parent = forest(len(keys), *(np.concatenate(x) for x in zip((start, parent), *waiting)))
    own = np.flatnonzero(parent != start)
    return own, parent[own]


# Its distribution

def turned(fp: Column, rotation: Column) -> Column:
    """The fingerprint with block ``rotation`` in front."""
    out = fp
    for r in range(1, BLOCKS):
        out = F.when(rotation == r, F.shiftleft(fp, BLOCK_BITS * r).bitwiseOR(F.shiftrightunsigned(fp, BITS - BLOCK_BITS * r))).otherwise(out)
    return out


def _turn_back(keys: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    shift = (rotation * BLOCK_BITS).astype(np.uint64)
    left = (np.uint64(BITS) - shift) % np.uint64(BITS)
    return ((keys >> shift) | np.where(shift == 0, np.uint64(0), keys << left)).view(np.int64)


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", BITS - depth) if depth < BITS else F.col("key")


def _walk(rows: DataFrame, depth: int, batch: int = 1 << 16) -> DataFrame:
    """Links of work items, which are pairs of trie nodes at ``depth``.

    ``rows(rotation, pa, pb, side, key)``: the keys below node ``pa`` (side 0)
    and, for two different nodes, below ``pb`` (side 1). Items are dealt to
    tasks whole; a task walks many small ones at once and holds ``batch`` keys
    or one item.
    """
    def links(rotation, pa_, pb, side, key) -> dict:
        item = np.r_[True, (rotation[1:] != rotation[:-1]) | (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1])]
        begin = np.flatnonzero(item | np.r_[True, side[1:] != side[:-1]])
        end, lead = np.r_[begin[1:], len(key)], item[begin]
        first = np.flatnonzero(lead)
        second = np.where(np.r_[~lead[1:], False][first], first + 1, first)
        lo, hi, lo2, hi2 = begin[first], end[first], begin[second], end[second]
        alone = (lo == lo2) & (hi - lo == 1)
        lo, hi, lo2, hi2 = (x[~alone] for x in (lo, hi, lo2, hi2))
        keys = key.view(np.uint64)
        err = np.bitwise_count(pa_[lo] ^ pb[lo]).astype(np.int64)
        x, y = spanning_links(keys, lo, hi, lo2, hi2, err, depth)
        return {"a": pa.array(_turn_back(keys[x], rotation[x])), "b": pa.array(_turn_back(keys[y], rotation[y]))}

    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        for part in parts:
            own = [part[c].to_numpy(zero_copy_only=False) for c in ("rotation", "pa", "pb", "side", "key")]
            held = [np.concatenate(x) for x in zip(held, own)] if held else [np.array(x) for x in own]
            if len(held[4]) >= batch:
                new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1]))
                if len(new):
                    cut = int(new[-1]) + 1
                    yield links(*(x[:cut] for x in held))
                    held = [x[cut:] for x in held]
        if held and len(held[4]):
            yield links(*held)

    items = ["rotation", "pa", "pb"]
    return map_texts(rows.select(*items, "side", "key").repartition(*items).sortWithinPartitions(*items, "side", "key"), run, "a long, b long",
                     rows=10000)


def near_links(fps: DataFrame, crowd: int = 20000) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fps(fp)`` within three bits of each other.

    Two fingerprints that differ in three bits agree in one of four blocks. For
    each block the bits are turned so that it comes first, and the upper levels
    of that trie admit equal nodes only; below, pairs of nodes are walked
    together under the error budget. A pair of nodes with more than ``crowd``
    keys is taken apart by Spark, ``STEP`` levels at a time, into the pairs of
    children that the budget leaves, so no task gets a crowded node whole.
    """
    rows = (fps.select("fp", F.explode(F.array(*[F.lit(r) for r in range(BLOCKS)])).alias("rotation"))
            .select("rotation", turned(F.col("fp"), F.col("rotation")).alias("key")).withColumn("node", _prefix(BLOCK_BITS)))
    full = stored(rows.groupBy("rotation", "node").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).drop("n"), "crowded")
    light = rows.join(full, ["rotation", "node"], "left_anti")
    found = _walk(light.select("rotation", F.col("node").alias("pa"), F.col("node").alias("pb"), F.lit(0).alias("side"), "key"), BLOCK_BITS)
    if full.isEmpty():
        return found
    members = stored(rows.join(full, ["rotation", "node"], "left_semi").drop("node"), "members")
    pairs, depth = full.select("rotation", F.col("node").alias("pa"), F.col("node").alias("pb")), BLOCK_BITS
    while depth < BITS and not pairs.isEmpty():
        kids = members.groupBy("rotation", _prefix(depth).alias("up"), _prefix(depth + STEP).alias("kid")).agg(F.count("*").alias("n"))
        depth += STEP
        left = kids.select("rotation", F.col("up").alias("pa"), F.col("kid").alias("ka"), F.col("n").alias("na"))
        right = kids.select("rotation", F.col("up").alias("pb"), F.col("kid").alias("kb"), F.col("n").alias("nb"))
        near = (F.bit_count(F.col("ka").bitwiseXOR(F.col("kb"))) <= BUDGET) & ((F.col("pa") != F.col("pb")) | (F.col("ka") <= F.col("kb")))
        same = F.col("ka") == F.col("kb")
        next_ = stored(pairs.join(left, ["rotation", "pa"]).join(right, ["rotation", "pb"]).filter(near).filter(~same | (F.col("na") > 1))
                       .select("rotation", F.col("ka").alias("pa"), F.col("kb").alias("pb"),
                               F.when(same, F.col("na")).otherwise(F.col("na") + F.col("nb")).alias("n")), "node-pairs")
        ready = next_.filter(F.col("n") <= crowd) if depth < BITS else next_
        at = members.withColumn("node", _prefix(depth))
        first = ready.withColumn("node", F.col("pa")).join(at, ["rotation", "node"]).withColumn("side", F.lit(0))
        second = ready.filter("pa <> pb").withColumn("node", F.col("pb")).join(at, ["rotation", "node"]).withColumn("side", F.lit(1))
        found = found.unionByName(_walk(first.unionByName(second), depth))
        pairs = next_.filter(F.col("n") > crowd).drop("n")
    return found


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", crowd: int = 20000) -> DataFrame:
    """``(doc_id, fingerprint, component_id, group, k, h)`` for every row.

    ``fingerprint`` is 16 hexadecimal digits, ``component_id`` the smallest
    identifier reachable over links of three bits or fewer, itself included;
    null identifiers are never smallest, and a component of null identifiers
    only has a null, which ``group`` (a fingerprint of the component) still tells apart. A text without words (null too) has fingerprint 0 and is
    linked like any other. ``k`` and ``h`` are the sort key of the identifier
    and the hash of the text, for joining; rows that repeat both are one
    document and all come back. Equal fingerprints meet once, however many
    documents have them, and no other column is read.
    """
    rows = stored(fingerprints(docs, ident, text), "fingerprints")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(near_links(first.select("fp"), crowd))
    member = first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = member.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = member.join(named, "root").select("fp", "component_id", F.col("root").alias("group"))
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group", "k", "h")
