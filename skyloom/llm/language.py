"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs, one from each side, read windows of bytes; an output layer on both
states gives every byte position a distribution over languages, and a
document's distribution is the mean over its positions. The network is trained
in numpy by backpropagation through time on a bounded sample of labelled rows;
Spark applies it to every byte of every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import as_bytes, map_texts, short_batches

PAD = 255  # a byte that UTF-8 never uses fills the last window of a text
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """Weights. ``inputs[d]`` (3H, 256), ``states[d]`` (3H, H) for both directions; gates in the order reset, update, candidate."""

    languages: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    out: np.ndarray  # (L, 2H)
    bias: np.ndarray  # (L,)


def _gates(table: np.ndarray, weights: np.ndarray, symbols: np.ndarray, keep: bool):
    """States of one direction, (T, H, B); with ``keep`` also what backpropagation needs.

    Reset and update gates are hard sigmoids, the candidate is a hyperbolic
    tangent. A padding symbol holds the update gate open, so the state stays.
    """
    steps, batch = symbols.shape
    size = weights.shape[1]
    states = np.empty((steps, size, batch), np.float32)
    h = np.zeros((size, batch), np.float32)
    g, u = np.empty((3 * size, batch), np.float32), np.empty((3 * size, batch), np.float32)
    trace = []
    for t in range(steps):
        np.take(table, symbols[t], axis=1, out=g, mode="clip")
        np.matmul(weights, h, out=u)
        a = g[:2 * size]
        a += u[:2 * size]
        np.maximum(a, 0, out=a)
        np.minimum(a, 1, out=a)
        n, reach = g[2 * size:], u[2 * size:]
        if keep:
            before, raw = h.copy(), reach.copy()
        reach *= a[:size]
        n += reach
        np.tanh(n, out=n)
        if keep:
            trace.append((before, g.copy(), raw))
        new = states[t]
        np.subtract(h, n, out=new)
        new *= a[size:]
        new += n
        h = new
    return (states, trace) if keep else states


def _back(table, weights, symbols, trace, grad_states):
    """Gradients of one direction by going back through time."""
    size = weights.shape[1]
    d_table, d_weights = np.zeros_like(table), np.zeros_like(weights)
    d_h = np.zeros_like(grad_states[0])
    for t in range(len(trace) - 1, -1, -1):
        before, g, raw = trace[t]
        r, z, n = g[:size], g[size:2 * size], g[2 * size:]
        d_h = d_h + grad_states[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (before - n) * ((z > 0) & (z < 1))
        d_raw = d_n * r
        d_r = d_n * raw * ((r > 0) & (r < 1))
        d_in = np.concatenate([d_r, d_z, d_n])
        d_u = np.concatenate([d_r, d_z, d_raw])
        for k in range(3 * size):
            d_table[k] += np.bincount(symbols[t], d_in[k], minlength=PAD + 1).astype(np.float32)
        d_weights += d_u @ before.T
        d_h = d_h * z + weights.T @ d_u
    d_table[:, PAD] = 0
    return d_table, d_weights


def initial(languages: list[str], size: int, rng: np.random.Generator) -> Network:
    inputs, states = [], []
    for _ in range(2):
        table = rng.normal(0, 0.3, (3 * size, PAD + 1)).astype(np.float32)
        table[:2 * size] += 0.5
        table[:, PAD] = 0
        table[size:2 * size, PAD] = 1000
        inputs.append(table)
        states.append((rng.normal(0, 0.5, (3 * size, size)) / np.sqrt(size)).astype(np.float32))
    return Network(languages, inputs, states, rng.normal(0, 0.3, (len(languages), 2 * size)).astype(np.float32),
                   np.zeros(len(languages), np.float32))


def positions(net: Network, symbols: np.ndarray) -> np.ndarray:
    """Probabilities (T, L, B) of the languages at every position of the windows ``symbols`` (T, B)."""
    ahead = _gates(net.inputs[0], net.states[0], symbols, False)
    behind = _gates(net.inputs[1], net.states[1], symbols[::-1], False)[::-1]
    size = net.states[0].shape[1]
    p = np.matmul(net.out[:, :size], ahead)
    p += np.matmul(net.out[:, size:], behind)
    p += net.bias[:, None]
    np.exp(p, out=p)  # states are within -1 and 1, so logits are bounded by the weights
    whole = p[:, 0].copy()
    for k in range(1, p.shape[1]):
        whole += p[:, k]
    p /= whole[:, None]
    return p


def train(snippets: list[bytes], labels: list[str], size: int = 8, window: int = 48, batch: int = 256, steps: int = 240,
          rate: float = 0.02, seed: int = 7) -> Network:
    """Fit the network on labelled snippets by Adam on the cross entropy of every position; languages weigh the same."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = initial(languages, size, rng)
    cut, own = [], []
    for text, label in zip(snippets, labels):
        for at in range(0, max(1, len(text)), window):
            piece = np.full(window, PAD, np.uint8)
            raw = np.frombuffer(text[at:at + window], np.uint8)
            piece[:len(raw)] = raw
            cut.append(piece)
            own.append(languages.index(label))
    symbols, own = np.array(cut), np.array(own)
    share = 1 / np.bincount(own, minlength=len(languages))[own]
    params = [*net.inputs, *net.states, net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.choice(len(own), batch, p=share / share.sum())
        x, y = np.ascontiguousarray(symbols[pick].T), own[pick]
        (fs, ft), (bs, bt) = _gates(net.inputs[0], net.states[0], x, True), _gates(net.inputs[1], net.states[1], x[::-1], True)
        back = bs[::-1]
        logits = np.matmul(net.out[:, :size], fs) + np.matmul(net.out[:, size:], back) + net.bias[:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(batch)] -= 1
        real = (x != PAD)[:, None, :]
        d = (p * real / max(1, real.sum())).astype(np.float32)
        d_out = np.concatenate([np.einsum("tlb,thb->lh", d, fs), np.einsum("tlb,thb->lh", d, back)], axis=1)
        d_f, d_b = np.matmul(net.out[:, :size].T, d), np.matmul(net.out[:, size:].T, d)
        (df, dfw), (db, dbw) = (_back(net.inputs[0], net.states[0], x, ft, d_f),
                                _back(net.inputs[1], net.states[1], x[::-1], bt, d_b[::-1]))
        grads = [df, db, dfw, dbw, d_out, d.sum(axis=(0, 2))]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        now = rate * min(1, step / 20) * (1 - 0.9 * step / steps)
        for value, grad, m, v in zip(params, grads, first, second):
            grad = grad * min(1, 1 / max(norm, 1e-9))
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (T, B) of all texts cut into windows, and the text of each window."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    flat = np.full(int(counts.sum()) * window, PAD, np.uint8)
    at = 0
    for text, n in zip(texts, counts):
        flat[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += int(n) * window
    return flat.reshape(-1, window), np.repeat(np.arange(len(texts)), counts)


def pooled(net: Network, texts: list[bytes], window: int = 64, at_once: int = 4096) -> np.ndarray:
    """Mean probabilities (texts, L) over all positions of each whole text; zero for an empty one."""
    total = np.zeros((len(texts), len(net.languages)))
    symbols, owner = windows(texts, window)
    for begin in range(0, len(owner), at_once):
        x = np.ascontiguousarray(symbols[begin:begin + at_once].T)
        p = positions(net, x)
        if (x[-1] == PAD).any():
            p *= (x != PAD)[:, None, :]
        sums, who = p.sum(axis=0).T, owner[begin:begin + at_once]
        starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        np.add.at(total, who[starts], np.add.reduceat(sums, starts, axis=0))
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def training_rows(docs: DataFrame, allowed: Column, per_language: int, ident: str, text: str, lang: str) -> tuple[list[bytes], list[str]]:
    """A bounded sample of labelled rows: at most about ``per_language`` of each language, chosen by a hash of the row.

    The counts cover all rows; the hash decides which rows come in, so the
    sample depends on the rows alone. Of each sampled text the network sees 384
    characters from a hashed place.
    """
    rows = docs.select(F.col(ident).cast("string").alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"),
                       allowed.alias("ok")).filter("ok and l is not null and t rlike '[^\\\\W\\\\d_]|\\\\p{L}'").drop("ok")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    draw = F.pmod(F.xxhash64(F.lit(11), "d", "t"), F.lit(1 << 40)) / float(1 << 40)
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 1.2 * per_language / n))]), F.col("l"))
    start = (F.pmod(F.xxhash64(F.lit(13), "d", "t"), F.greatest(F.lit(1), F.length("t") - 384)) + 1).cast("int")
    picked = (rows.select("l", F.substring(F.col("t"), start, F.lit(384)).alias("s"), (draw / rate).alias("draw")).filter("draw < 1")
              .orderBy("draw", "l", "s").limit(2 * per_language * len(counts)).collect())
    return [r["s"].encode() for r in picked], [r["l"] for r in picked]


def fit(docs: DataFrame, allowed: Column | None = None, per_language: int = 400, ident: str = "doc_id", text: str = "text",
        lang: str = "lang", **options) -> Network | None:
    """Train on a sample of the rows that ``allowed`` selects; None where no row is labelled."""
    snippets, labels = training_rows(docs, F.lit(True) if allowed is None else allowed, per_language, ident, text, lang)
    return train(snippets, labels, **options) if labels else None


def predict(docs: DataFrame, net: Network | None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text.

    A null text and one without a letter are ``und`` with score 0, as is every
    text when the network is None. Ties go to the language that sorts first.
    Only the text is read for a prediction; repeated rows give repeated results.
    """
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            lang, score = judge(net, as_bytes(part["t"]))
            yield {"doc_id": part["d"], "lang_pred": lang, "score": score}

    return map_texts(docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t")), run,
                     "doc_id long, lang_pred string, score double", rows=4096, megabytes=2)


def judge(net: Network | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    lettered = [net is not None and has_letter(t) for t in texts]
    if net is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    p = pooled(net, [t if ok else b"" for t, ok in zip(texts, lettered)])
    best = p.argmax(axis=1)
    return ([net.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)],
            [min(1.0, float(p[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered))])


def score_column(spark: SparkSession, net: Network | None, text: str = "text") -> Column:
    """The score of ``predict`` as a column, for filtering rows without moving them."""
    short_batches(spark)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out: list[float] = []
        for at in range(0, len(texts), 512):
            out += judge(net, [(t or "").encode() for t in texts.iloc[at:at + 512]])[1]
        return pd.Series(out, dtype="float64")

    return score(F.col(text))


def label_runs(docs: DataFrame, net: Network, ident: str = "doc_id", text: str = "text", window: int = 64) -> DataFrame:
    """The label of every byte position, as runs ``(doc_id, start, end, lang)`` in bytes of the UTF-8 text."""
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            texts, out = as_bytes(part["t"]), {"doc_id": [], "start": [], "end": [], "lang": []}
            symbols, owner = windows(texts, window)
            best = positions(net, np.ascontiguousarray(symbols.T)).argmax(axis=1).T if len(owner) else np.zeros((0, window), int)
            for i, (d, t) in enumerate(zip(part["d"].to_pylist(), texts)):
                if not t:
                    continue
                own = best[owner == i].ravel()[:len(t)]
                cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for a, b in zip(cuts, cuts[1:]):
                    for k, v in zip(out, (d, a, b, net.languages[own[a]])):
                        out[k].append(v)
            yield out

    return map_texts(docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t")), run,
                     "doc_id long, start long, end long, lang string")


def held_out(ident: str = "doc_id") -> Column:
    """Whether crc32 of the identifier as text leaves 2 when divided by 4; a null identifier is not held out."""
    return F.coalesce(F.crc32(F.col(ident).cast("string").cast("binary")) % 4 == 2, F.lit(False))
