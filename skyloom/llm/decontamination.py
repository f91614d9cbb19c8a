"""Benchmark passages in documents, by greedy string tiling."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_strings, map_texts, order_id, text_key

_WORD = re.compile(r"\w+")
BASE = 1_000_003  # of the rolling hash
MODULUS = (1 << 61) - 1
HITS = "k long, h long, item_id long, coverage double"


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rolling(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """``(place, hash)`` of every window of ``size`` tokens that are all free, each hash made from the one before."""
    top, value, run = pow(BASE, size - 1, MODULUS), 0, 0
    for end, token in enumerate(ids):
        if not free[end]:
            value = run = 0
            continue
        if run >= size:
            value = (value - ids[end - size] * top) % MODULUS
        value = (value * BASE + token) % MODULUS
        run += 1
        if run >= size:
            yield end - size + 1, value


def tile(pattern: list[int], text: list[int], least: int, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin matching: tiles ``(place in pattern, place in text, length)``.

    Windows of one size are hashed and looked up; equal ones are checked and
    extended as far as unmarked tokens agree. A match over twice the size starts
    the search again with its length; otherwise matches are marked from the
    longest down unless a longer tile has taken their tokens, and the size is
    halved until it is ``least``. A negative token of the text matches nothing.
    """
    open_p, open_t = [True] * len(pattern), [v >= 0 for v in text]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(start, len(pattern)))
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for at, value in _rolling(text, open_t, size):
            table[value].append(at)
        matches: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for p, value in _rolling(pattern, open_p, size):
            for t in table.get(value, ()):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and pattern[p + n] == text[t + n] and open_p[p + n] and open_t[t + n]:
                    n += 1
                if n >= size:
                    matches[n].append((p, t))
                    longest = max(longest, n)
            if longest > 2 * size:
                break
        if longest > 2 * size:
            size = longest
            continue
        for n in sorted(matches, reverse=True):
            for p, t in matches[n]:
                if all(open_p[p:p + n]) and all(open_t[t:t + n]):
                    open_p[p:p + n], open_t[t:t + n] = [False] * n, [False] * n
                    tiles.append((p, t, n))
                # what is left of an occluded match is found again, as its tokens are still open
        again = any(n >= size and _left_open(open_p, open_t, m, n, size) for n, ms in matches.items() for m in ms)
        if again:
            continue
        if size == least:
            return sorted(tiles)
        size = max(least, size // 2)


def _left_open(open_p: list[bool], open_t: list[bool], match: tuple[int, int], n: int, size: int) -> bool:
    """Whether ``size`` tokens in a row of a match are still open on both sides."""
    run = 0
    for i in range(n):
        run = run + 1 if open_p[match[0] + i] and open_t[match[1] + i] else 0
        if run >= size:
            return True
    return False


class Seeds:
    """Runs of ``least`` tokens of a block of benchmark items, for looking up documents."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.words, self.items, self.grams = least, {}, {}, {}
        grams: dict[int, list[int]] = defaultdict(list)
        for ident, text in items:
            own = [self.words.setdefault(w, len(self.words)) for w in tokens(text)]
            if len(own) < least:
                continue
            self.items[ident] = own
            self.grams[ident] = self._grams(np.array(own, np.int64))
            for value in set(self.grams[ident].tolist()):
                grams[value].append(ident)
        self.values = np.array(sorted(grams), np.int64)
        self.owners = [grams[v] for v in self.values.tolist()]

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n, value = len(ids) - self.least + 1, 0
        with np.errstate(over="ignore"):
            for k in range(self.least):
                value = value * np.int64(-7046029254386353131) + ids[k:k + n] + 1
        return value

    def reach(self, ident: int, found: list[int]) -> int:
        """How many tokens of an item the seeds ``found`` cover."""
        hit = np.isin(self.grams[ident], self.values[found])
        return int((np.convolve(hit, np.ones(self.least, np.int64)) > 0).sum())

    def look_up(self, text: str) -> tuple[list[int], dict[int, list[int]]]:
        """The places of seeds in the text, cut out with a gap between runs, and the items that share one."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in tokens(text)], np.int64)
        if len(ids) < self.least or not len(self.values):
            return [], {}
        known = ids >= 0
        whole = known[:len(ids) - self.least + 1].copy()
        for k in range(1, self.least):
            whole &= known[k:len(ids) - self.least + 1 + k]
        at = np.flatnonzero(whole)
        if not len(at):
            return [], {}
        value = self._grams(ids)[at]
        place = np.minimum(np.searchsorted(self.values, value), len(self.values) - 1)
        hit = self.values[place] == value
        at, place = at[hit], place[hit]
        if not len(at):
            return [], {}
        covered = np.zeros(len(ids), bool)
        for k in range(self.least):
            covered[at + k] = True
        cut: list[int] = []
        edges = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
        for a, b in zip(edges[::2], edges[1::2]):
            cut += [*ids[a:b].tolist(), -1]
        shared: dict[int, list[int]] = defaultdict(list)
        for g in np.unique(place).tolist():
            for ident in self.owners[g]:
                shared[ident].append(g)
        return cut, shared


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5, block: int = 20000, ident: str = "doc_id",
               text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(k, h, item_id, coverage)`` for every document and benchmark item of which tiles cover at least ``coverage``.

    The benchmark is the query set: it goes through in blocks of ``block``
    items, and each block is looked up in all documents. Runs of ``least``
    tokens that a document shares with an item are the seeds that bring the two
    together; greedy string tiling of the item against those parts of the
    document then gives the share of the item's tokens that tiles cover, in
    whatever order they stand. An item of fewer tokens than ``least`` (a null
    text has none) and a null item never match; items that repeat an identifier
    are told apart by their text and the larger coverage counts.
    """
    rows = docs.select(order_id(ident).alias("k"), text_key(text).alias("h"), F.col(text).alias("t"))
    queries = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    blocks, now = [], []
    for n, row in enumerate(queries.toLocalIterator()):
        now.append((n, row["i"], row["t"]))
        if len(now) == block:
            blocks, now = [*blocks, now], []
    blocks = [*blocks, now] if now or not blocks else blocks

    def hits(members: list[tuple[int, int, str]]) -> DataFrame:
        names = {n: i for n, i, _ in members}
        seeds = Seeds([(n, t) for n, _, t in members], least)

        def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
            for part in parts:
                out: dict[str, list] = {c: [] for c in ("k", "h", "item_id", "coverage")}
                for k, h, value in zip(part["k"].to_pylist(), part["h"].to_pylist(), as_strings(part["t"])):
                    cut, shared = seeds.look_up(value)
                    for n, grams in shared.items():
                        own = seeds.items[n]
                        if seeds.reach(n, grams) < coverage * len(own):
                            continue  # tiles consist of seeds, and these don't cover enough
                        share = sum(size for _, _, size in tile(own, cut, least)) / len(own)
                        if share >= coverage:
                            for column, v in zip(out.values(), (k, h, names[n], share)):
                                column.append(v)
                yield out

        return map_texts(rows, run, HITS)

    return (reduce(DataFrame.unionByName, [hits(b) for b in blocks]).groupBy("k", "h", "item_id").agg(F.max("coverage").alias("coverage")))


def flag_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5, ident: str = "doc_id", text: str = "text",
               **options) -> DataFrame:
    """One row per document: whether it is contaminated, by how many items, and the item covered most (the smallest of equal ones).

    Null and empty texts are clean. Rows that repeat identifier and text are
    judged alike. Other columns are not read.
    """
    hits = find_leaks(docs, benchmark, least, coverage, ident=ident, text=text, **options)
    worst = hits.groupBy("k", "h").agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", (-F.col("item_id")).alias("i"))).alias("m"))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), order_id(ident).alias("k"), text_key(text).alias("h"))
    return rows.join(worst, ["k", "h"], "left").select(
        "doc_id", F.col("m").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("m.i")).alias("item_id"), F.coalesce("m.coverage", F.lit(0.0)).alias("coverage"))
