"""Removal of sentences that repeat elsewhere in the corpus, found by sliding spans of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_strings, map_texts, order_id, stored, text_key

SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)")
_WORD = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of every sentence; together they are the whole text. Pieces without a word join the sentence before them."""
    out: list[tuple[int, int, list[str]]] = []
    low, find = text.lower(), _WORD.findall
    aligned = len(low) == len(text)  # a few capital letters have longer small ones
    for m in SENTENCE.finditer(text):
        begin, end = m.span()
        if begin == end:
            continue
        words = find(low, begin, end) if aligned else find(text[begin:end].lower())
        if words or not out:
            out.append((begin, end, words))
        else:
            out[-1] = (out[-1][0], end, out[-1][2])
    return out


def runs(parts: list[tuple[int, int, list[str]]], least: int, words: int, enough: int) -> Iterator[tuple[int, int, bytes]]:
    """``(first, last, digest)`` of every shortest run of ``least`` sentences and ``words`` words, or of ``enough`` words.

    From every sentence the shortest run that begins with it, and the shortest
    that ends with it, so that a repeated passage is covered up to its last
    sentence. A text that is shorter than any run is a run as a whole.
    """
    sizes, joined, begin, at = [], [], [], 0
    for _, _, own in parts:
        piece = (" ".join(own) + " ").encode()
        begin.append(at)
        at += len(piece)
        joined.append(piece)
        sizes.append(len(own))
    whole, begin = b"".join(joined), [*begin, at]
    n = len(parts)

    def full(total: int, count: int) -> bool:
        return total >= words and count >= least or total >= enough

    def run(first: int, last: int) -> tuple[int, int, bytes]:
        return first, last, xxhash.xxh3_128_digest(whole[begin[first]:begin[last + 1]])

    ends: list[int] = []  # of the runs that begin with sentence 0, 1, ...
    last, total = -1, 0
    for first in range(n):
        while last + 1 < n and not full(total, last - first + 1):
            last += 1
            total += sizes[last]
        if not full(total, last - first + 1):
            break
        ends.append(last)
        yield run(first, last)
        total -= sizes[first]
    if not ends:
        if sum(sizes):
            yield run(0, n - 1)
        return
    first, total = 0, 0
    for last in range(n):
        total += sizes[last]
        while full(total - sizes[first], last - first):
            total -= sizes[first]
            first += 1
        if full(total, last - first + 1) and not (first < len(ends) and ends[first] == last):
            yield run(first, last)


def span_rows(docs: DataFrame, least: int, words: int, enough: int) -> DataFrame:
    """A row for every run of every document: 128 bits of its words, the document's key and the run's first and last sentence."""
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            digests, firsts, lasts, counts = [], [], [], []
            for text in as_strings(part["t"]):
                before = len(firsts)
                for first, last, digest in runs(sentences(text), least, words, enough):
                    digests.append(digest)
                    firsts.append(first)
                    lasts.append(last)
                counts.append(len(firsts) - before)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            own = {c: np.repeat(part[c].to_numpy(zero_copy_only=False), counts) for c in ("k", "h")}
            yield {"p": pa.array(halves[:, 0].copy()), "q": pa.array(halves[:, 1].copy()), "k": pa.array(own["k"]), "h": pa.array(own["h"]),
                   "first": firsts, "last": lasts}

    return map_texts(docs, run, "p long, q long, k long, h long, first int, last int", megabytes=2)


def repeated_spans(docs: DataFrame, least: int = 3, words: int = 20, enough: int = 40, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(k, h, spans)``: for each document, the runs of sentences that occur before, as an array of ``(first, last)``."""
    rows = span_rows(docs.select(order_id(ident).alias("k"), text_key(text).alias("h"), F.col(text).alias("t")), least, words, enough)
    seen = stored(rows.groupBy("p", "q").agg(F.min(F.struct("k", "h", "first")).alias("origin"), F.count("*").alias("n"))
                  .filter("n > 1").drop("n"), "origins")  # as a table of its own, so that the join can split a hot hash
    again = rows.join(seen, ["p", "q"]).filter(F.struct("k", "h", "first") != F.col("origin"))
    return again.groupBy("k", "h").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = 3, words: int = 20, enough: int = 40, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its sentences, those removed, their places and the text that stays.

    Runs of consecutive sentences are hashed over their lower-cased words: from
    each sentence, forwards and backwards, the shortest run of ``least``
    sentences that has ``words`` words, or of any number that has ``enough``
    words, so that a passage of few long sentences counts too, and a text
    without such a run as a whole. Every longer run consists of these. Runs with equal hashes meet in one global
    aggregate; the first occurrence (smallest identifier, then text, then place)
    stays, and every sentence that any other occurrence covers is removed.
    ``removed`` lists ``start:end`` in code points, end exclusive. A null text
    is empty, an empty table gives an empty one, other columns are not read; rows that repeat identifier and text are one document, so they
    don't repeat each other; a null identifier comes first. Hashes are combined
    before the shuffle, so a passage in a third of all documents costs a row per
    task; where its rows meet the answer, adaptive execution splits them.
    """
    keyed = docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t"), order_id(ident).alias("k"), text_key(text).alias("h"))
    joined = keyed.join(repeated_spans(docs, least, words, enough, ident, text), ["k", "h"], "left").select("d", "t", "spans")

    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("n_sentences", "n_removed", "removed", "text")}
            for value, spans in zip(as_strings(part["t"]), part["spans"].to_pylist()):
                found = sentences(value)
                gone = {i for s in spans or () for i in range(s["first"], s["last"] + 1)}
                out["n_sentences"].append(len(found))
                out["n_removed"].append(len(gone))
                out["removed"].append(",".join(f"{found[i][0]}:{found[i][1]}" for i in sorted(gone)))
                out["text"].append("".join(value[a:b] for i, (a, b, _) in enumerate(found) if i not in gone) if gone else value)
            yield {"doc_id": part["d"], **out}

    return map_texts(joined, run, "doc_id long, n_sentences long, n_removed long, removed string, text string")
