"""Periodic runs against a direct search of all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from skyloom.llm import periods
from skyloom.llm.queries import QUERIES
from test_registered import SF_DIR

LAYOUT = "doc_id long, text string"


def brute_runs(words, least=24):
    codes = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    smallest = {}
    for q in range(1, len(words) // 3 + 1):
        step = np.diff(np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if b - a + q >= max(least, 3 * q):
                smallest.setdefault((a, b - a + q), q)
    return sorted(((a, n, q) for (a, n), q in smallest.items()), key=lambda r: (r[0], r[2]))


def brute_row(words, least=24):
    runs = brute_runs(words, least)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listing = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(ident, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(ident).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


@pytest.mark.skipif(not __import__("os").path.isdir(SF_DIR), reason="test tables are not there")
def test_query_against_all_periods(spark):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(texts) and any(r[0] for r in got.values())
    for ident, text in texts:
        assert got[ident] == brute_row(planted(ident, text)), ident


def random_texts(rng, count):
    for i in range(count):
        kind = rng.randrange(4)
        if kind == 0:
            words = rng.choices("ab", k=rng.randrange(0, 200))
        elif kind == 1:  # a root with its own inner repetition, repeated
            root = rng.choices("abc", k=rng.randrange(1, 6)) * rng.randrange(1, 9) + rng.choices("abc", k=rng.randrange(0, 30))
            words = root * rng.randrange(1, 9)
        elif kind == 2:
            words = sum((rng.choices("abcdefgh", k=rng.randrange(0, 20)) + rng.choices("abcd", k=rng.randrange(1, 40)) * rng.randrange(1, 6) for _ in range(4)), [])
        else:  # Fibonacci words have runs of every scale
            a, b = ["a"], ["a", "b"]
            while len(b) < rng.randrange(20, 500):
                a, b = b, b + a
            words = b
        yield i, " ".join(words)


def test_random_texts(spark):
    rows = list(random_texts(random.Random(5), 400))
    for least in (24, 6, 1):
        got = {r["doc_id"]: r for r in periods.find_runs(spark.createDataFrame(rows, LAYOUT), least=least).collect()}
        for i, text in rows:
            words = text.encode().split()
            assert [tuple(r) for r in got[i]["runs"]] == brute_runs(words, least), (least, text)
            assert tuple(got[i])[1:8] == brute_row(words, least)


def test_long_text_crosses_many_tiles(spark):
    rng = random.Random(3)
    root = [f"w{rng.randrange(500)}" for _ in range(7001)]
    words = [f"x{i}" for i in range(333)] + root * 4 + [f"y{i}" for i in range(50)] + ["same"] * 30000
    got = periods.find_runs(spark.createDataFrame([(1, " ".join(words))], LAYOUT)).first()
    assert [tuple(r) for r in got["runs"]] == [(333, 28004, 7001), (28387, 30000, 1)]
    assert (got["start"], got["period"], got["exponent_milli"]) == (28387, 1, 30_000_000)
    assert got["collapsed_sha256"] == hashlib.sha256(" ".join([*words[:333], *root, *words[28337:28387], "same"]).encode()).hexdigest()


def test_one_repeated_word_has_few_fragments(spark):
    found = periods.fragments(spark.createDataFrame([(1, "a " * 20000)], LAYOUT)).first()["fragments"]
    assert {f["q"] for f in found} == {1} and len(found) <= 20000 // 8


def test_edges(spark):
    run = "a b " * 20
    rows = [(1, None, 0), (2, "", 0), (None, run, 0), (None, None, 0), (3, run, 0), (3, run, 1), (4, "ab cd " * 24, 0), (5, "a b " * 11 + "a", 0)]
    docs = spark.createDataFrame(rows, LAYOUT + ", q int").withColumnsRenamed({"q": "runs"})
    got = sorted(((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"]) for r in periods.find_runs(docs).collect()), key=str)
    assert got == sorted([(1, 0, None, None, None), (2, 0, None, None, None), (None, 1, 0, 40, 2), (None, 0, None, None, None), (3, 1, 0, 40, 2),
                          (3, 1, 0, 40, 2), (4, 1, 0, 24, 1), (5, 0, None, None, None)], key=str)
    assert periods.find_runs(docs.limit(0)).count() == 0


def test_ties_name_the_first_then_the_shorter_period(spark):
    text = " ".join(["a"] * 30 + ["x"] + ["b"] * 30)
    got = periods.find_runs(spark.createDataFrame([(1, text)], LAYOUT)).first()
    assert (got["n_runs"], got["start"], got["length"]) == (2, 0, 30)
