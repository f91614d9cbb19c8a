"""Periodic runs of words: tiles per octave of periods, solved apart, stitched per document and period.

A run is a stretch whose words ``q`` apart are identical, ``q`` being its
smallest period, of at least ``max(least, 3 q)`` words. Its *matches* are the
positions ``i`` with ``w[i] == w[i + q]``: an interval of ``max(least, 3 q) - q``
positions at least, which is ``2 B`` or more when ``B`` is the lower end of the
octave of ``q`` (the first octave holds all periods below ``2 B``, ``B`` being a
third of ``least``). A boundary every ``B`` words therefore falls into
the first ``B`` matches of every run, and from it at least
``max(least, 3 q) - q - B + 1`` matches follow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import as_bytes, map_texts, order_id, stored, text_key

LEAST = 24
BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2^64


@lru_cache(maxsize=65536)
def _parts(q: int) -> tuple[int, ...]:
    """``q`` divided by each of its primes."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return tuple(found + ([q // rest] if rest > 1 else []))


def z_function(w: list) -> list[int]:
    """For every position, how many elements agree with the beginning."""
    n = len(w)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and w[k] == w[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def solve_tile(w: np.ndarray, at: int, low: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Fragments ``(q, first match, after the last match)`` at the boundary ``at`` of the periods of one octave.

    Only periods that are not a repetition of a shorter one. A fragment ends
    where its matches end, or where the tile does: then the next boundary has
    a fragment that begins no later.
    """
    top = 2 * low
    cap = max(2 * top, least) + 1
    piece = w[at:at + cap + top].tolist()
    z = z_function(piece)
    found = []
    for q in range(1 if low <= least // 3 else low, min(top, len(piece))):
        if z[q] < max(least, 3 * q) - q - low + 1 or any(z[p] >= q - p for p in _parts(q)):
            continue
        back = min(low, at)
        same = w[at - back:at] == w[at - back + q:at + q]
        other = np.flatnonzero(~same)
        found.append((q, at - back + (int(other[-1]) + 1 if len(other) else 0), at + z[q]))
    return found


def candidates(w: np.ndarray, starts: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, np.ndarray]]:
    """Octaves with the boundaries whose next ``B`` words stand again ``q`` words on, for any ``q`` of the octave.

    ``w`` are the words of texts one after the other, text ``d`` from
    ``starts[d]``, parted by elements that stand once. Windows are compared by
    a polynomial modulo 2^64: equal windows always agree.
    """
    sizes = np.diff(starts) - 1
    values = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(w), BASE, np.uint64)]))
    inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(w), pow(BASE, -1, 2 ** 64), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * powers[:-1], dtype=np.uint64)])
    low = first_octave = max(1, least // 3)
    while True:
        first = 1 if low == first_octave else low
        texts = np.flatnonzero(sizes >= max(least, 3 * first))
        if not len(texts):
            return
        window = (sums[low:] - sums[:-low]) * inverse[:len(w) - low + 1]
        periods = np.arange(first, 2 * low)
        counts = -(-sizes[texts] // low)
        at = np.repeat(starts[texts], counts) + low * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
        hit = []
        for part in np.array_split(at, max(1, len(at) * len(periods) // 2 ** 20)):
            other = part[:, None] + periods
            same = window[np.minimum(other, len(window) - 1)] == window[np.minimum(part, len(window) - 1)][:, None]
            hit.append(part[(same & (other < len(window))).any(axis=1)])
        yield low, np.concatenate(hit)
        low *= 2


FRAGMENT = StructType([StructField(n, LongType(), False) for n in ("q", "start", "stop")])
FOUND = StructType([
    StructField("doc_id", LongType()), StructField("k", LongType(), False), StructField("h", LongType(), False),
    StructField("text", StringType()), StructField("plain", StringType(), False), StructField("fragments", ArrayType(FRAGMENT, False)),
])


def fragments(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Per row the fragments of its tiles, its text where there are any, and the digest of all its words."""

    def run(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            codes: dict[bytes, int] = {}
            ids = cols["k"].to_pylist()
            arrays, starts, plain = [], [0], []
            for t in as_bytes(cols["text"]):
                words = t.split()  # bytes split at \x20 and \x09 to \x0D, and nowhere else
                plain.append(sha256(b" ".join(words)).hexdigest())
                arrays.append(np.fromiter((codes.setdefault(x, len(codes)) for x in words), np.int64, len(words)))
                starts.append(starts[-1] + len(words) + 1)
            parted = [x for d, a in enumerate(arrays) for x in (a, [len(codes) + d])]
            w, edges = np.concatenate(parted).astype(np.int64), np.array(starts)
            found: list[list[dict]] = [[] for _ in ids]
            for low, boundaries in candidates(w, edges, least):
                owners = np.searchsorted(edges, boundaries, side="right") - 1
                for at, d in zip(boundaries.tolist(), owners.tolist()):
                    own = arrays[d]
                    found[d] += [{"q": q, "start": s, "stop": e} for q, s, e in solve_tile(own, at - starts[d], low, least)]
            texts = cols["text"]
            yield {"doc_id": cols["doc_id"], "k": ids, "h": cols["h"], "plain": plain, "fragments": found,
                   "text": pa.array([texts[i].as_py() if f else None for i, f in enumerate(found)], pa.string())}

    return map_texts(docs.select(F.col(ident).cast("long").alias("doc_id"), order_id(ident).alias("k"), text_key(text).alias("h"),
                                 F.col(text).alias("text")), run, FOUND)


def stitch(pieces: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """Runs ``(start, length, q)`` from fragments that touch, per ``keys`` and period ``q``."""
    own = [*keys, "q"]
    before = Window.partitionBy(*own).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*own).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    joined = (
        pieces.groupBy(*own, "start").agg(F.max("stop").alias("stop"))
        .withColumn("new", F.coalesce((F.col("start") > F.max("stop").over(before)).cast("int"), F.lit(1)))
        .withColumn("run", F.sum("new").over(upto))
    )
    whole = joined.groupBy(*own, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("q")
    return whole.select(*own, "start", length.alias("length")).filter(F.col("length") >= F.greatest(F.lit(least), 3 * F.col("q")))


RESULT = StructType([
    StructField("doc_id", LongType()), StructField("n_runs", LongType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("period", LongType()), StructField("exponent_milli", LongType()), StructField("runs_sha256", StringType()),
    StructField("collapsed_sha256", StringType()),
    StructField("runs", ArrayType(StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")]), False)),
])


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words, without those that a run ``(start, length, period)`` holds after its first ``period`` words."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(edge).tolist()) if not inside]


def find_runs(docs: DataFrame, ident: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Every periodic run of every text, its strongest run, and digests of the runs and of the text without repetitions.

    Every text is cut into overlapping tiles once for each octave of periods
    ``[B, 2 B)``, with a boundary every ``B`` words. Windows of ``B`` words that
    do not stand again within the octave rule a tile out; the others get the
    Z-function of the words after the boundary. Fragments are dealt by document
    and period and joined where they touch. At a boundary at most two periods of
    an octave repeat twice without being repetitions themselves, so a text of
    ``n`` words has at most about ``n`` fragments.

    Texts are cut where they are read, as a tile is several times as large as
    the words it adds; only fragments, and texts that have any, are written.

    A null text has no words; a null identifier is one like any other. Rows that repeat identifier and text give one
    result each. Periods have no upper bound but a third of the text, and texts
    none at all. Of equally strong runs the first is named, then the shorter
    period. Further columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    tiles = stored(fragments(docs, ident, text, least), "period-tiles")
    pieces = tiles.filter(F.size("fragments") > 0).select("k", "h", F.explode("fragments").alias("f")).select("k", "h", "f.*")
    found = stitch(pieces, ["k", "h"], least).groupBy("k", "h").agg(
        F.sort_array(F.collect_list(F.struct("start", F.col("q").alias("period"), "length"))).alias("runs"))
    runs = stored(found, "period-runs")  # a hot identifier can be split when it is joined with a table
    rest = tiles.filter(F.size("fragments") == 0).withColumn("runs", F.expr("CAST(NULL AS array<struct<start:bigint,period:bigint,length:bigint>>)"))
    some = tiles.filter(F.size("fragments") > 0).join(runs, ["k", "h"], "left")

    def run(slices: Iterable[dict]) -> Iterator[dict]:
        for cols in slices:
            out: dict[str, list] = {n: [] for n in RESULT.fieldNames()}
            for name, t, plain, listed in zip(cols["doc_id"].to_pylist(), as_bytes(cols["text"]), cols["plain"].to_pylist(), cols["runs"].to_pylist()):
                own = [(r["start"], r["length"], r["period"]) for r in listed or ()]
                best = None
                for r in own:  # by start, then period: a later one must be stronger
                    if best is None or r[1] * best[2] > best[1] * r[2]:
                        best = r
                listing = "".join(f"{s},{n},{q}\n" for s, n, q in own)
                words = collapse(t.split(), own) if own else None
                row = (name, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(listing.encode()).hexdigest(),
                       plain if words is None else sha256(b" ".join(words)).hexdigest(),
                       [{"start": s, "length": n, "period": q} for s, n, q in own])
                for key, value in zip(out, row):
                    out[key].append(value)
            yield out

    names = ["doc_id", "text", "plain", "runs"]
    return map_texts(rest.select(*names).unionByName(some.select(*names)), run, RESULT)
