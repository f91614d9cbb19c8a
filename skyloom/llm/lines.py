"""Lines that follow a template which recurs across documents, by a log-template tree."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_strings, map_texts, order_id, short_batches, stored, text_key

WILDCARD = "<*>"
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^ \t\n\x0b\x0c\r]")
_SPACES = re.compile(r"[ \t\n\x0b\x0c\r]+")
LINES = "k long, h long, leaf long, leaf_first int, form long, size int, exact boolean, tokens string"


def masked(line: str) -> list[str]:
    """The tokens of a line; one with a digit is variable from the start."""
    return [WILDCARD if _DIGIT.search(w) else w for w in _SPACES.split(line) if w]


def _hash(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode("utf-8", "surrogatepass")), "little", signed=True)


def place(tokens: list[str], depth: int) -> tuple[int, int]:
    """The leaf of the tree, by token count and leading tokens, and the form (all tokens), as hashes."""
    return _hash("\t".join([str(len(tokens)), *tokens[:depth]])), _hash("\t".join(tokens))


def line_rows(docs: DataFrame, depth: int) -> DataFrame:
    """The distinct forms of every document's lines, with their leaf; ``leaf_first`` is 1 once per document and leaf, and an
    ``exact`` form has no variable token."""
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("k", "h", "leaf", "leaf_first", "form", "size", "exact", "tokens")}
            for k, h, text in zip(part["k"].to_pylist(), part["h"].to_pylist(), as_strings(part["t"])):
                forms, leaves = set(), set()
                for line in text.split("\n"):
                    tokens = masked(line)
                    if not tokens:
                        continue
                    leaf, form = place(tokens, depth)
                    if (leaf, form) in forms:
                        continue
                    for column, value in zip(out.values(), (k, h, leaf, int(leaf not in leaves), form, len(tokens),
                                                                 WILDCARD not in tokens, " ".join(tokens))):
                        column.append(value)
                    forms.add((leaf, form))
                    leaves.add(leaf)
            yield out

    return map_texts(docs, run, LINES, megabytes=4)


def repeated_lines(every: DataFrame) -> DataFrame:
    """``(k, h, form)`` of lines without a variable token that an earlier document has too."""
    exact = every.filter("exact").select("k", "h", "form")
    found = stored(exact.groupBy("form").agg(F.count("*").alias("n"), F.min(F.struct("k", "h")).alias("origin")).filter("n > 1"), "exact-lines")
    return exact.join(found, "form").filter(F.struct("k", "h") != F.col("origin")).select("k", "h", "form")


def recurring(every: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.7, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(lines, templates)`` of stored ``line_rows``: the lines ``(k, h, form, template)`` of leaves that ``min_docs`` documents share,
    and the recurring templates ``(template, pattern, n_docs, origin)``."""
    every = every.filter(F.col("size") >= least)
    shared = stored(every.groupBy("leaf").agg(F.sum("leaf_first").alias("n")).filter(F.col("n") >= min_docs).select("leaf"), "shared-leaves")
    lines = stored(every.join(shared, "leaf", "left_semi").select("k", "h", "leaf", "form", "tokens"), "lines")
    forms = lines.groupBy("leaf", "form").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    cells = forms.select("leaf", "form", "n", F.posexplode(F.split("tokens", " ")).alias("at", "token"))
    fixed = (cells.filter(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
             .filter((F.col("n") >= min_docs) & (F.col("token") != WILDCARD)).select("leaf", "at", "token", F.lit(True).alias("fixed")))
    steady = F.coalesce("fixed", (F.col("at") < depth) & (F.col("token") != WILDCARD))
    named = (cells.join(fixed, ["leaf", "at", "token"], "left")
             .groupBy("leaf", "form").agg(F.sort_array(F.collect_list(F.struct("at", F.when(steady, F.col("token")).otherwise(WILDCARD).alias("w")))).alias("ws"),
                                          F.avg(steady.cast("double")).alias("share"))
             .filter(F.col("share") >= similarity).select("leaf", "form", F.array_join("ws.w", " ").alias("pattern"))
             .withColumn("template", F.xxhash64("leaf", "pattern")))
    named = stored(named, "line-names")  # as a table of its own, so that the join can split a form that very many documents have
    own = lines.select("k", "h", "leaf", "form").join(named, ["leaf", "form"])
    per_doc = own.select("template", "pattern", "k", "h").distinct()
    templates = stored(per_doc.groupBy("template", "pattern").agg(F.count("*").alias("n_docs"), F.min(F.struct("k", "h")).alias("origin"))
                       .filter(F.col("n_docs") >= min_docs), "templates")
    return own.select("k", "h", "form", "template", "pattern"), templates


def clean(forms_and_text: list[tuple], depth: int, spare: bool = False) -> list[tuple[int, int, str | None]]:
    """``(lines, dropped lines, text)`` of each ``(text, forms to drop)``; ``spare``: a text that would keep no word stays whole."""
    out = []
    for value, forms in forms_and_text:
        found, gone = (value or "").split("\n"), set() if forms is None else set(forms)
        kept = [x for x in found if not (ts := masked(x)) or place(ts, depth)[1] not in gone] if gone else found
        if spare and len(kept) < len(found) and not any(map(_WORD.search, kept)):
            kept = found
        same = len(kept) == len(found)
        out.append((len(found) if value else 0, len(found) - len(kept), value if same else "\n".join(kept)))
    return out


def drop_templates(docs: DataFrame, min_docs: int = 5, depth: int = 3, similarity: float = 0.7, least: int = 3, ident: str = "doc_id",
                   text: str = "text", spare: bool = False) -> DataFrame:
    """The rows of ``docs`` with the text cleaned, and ``n_lines`` and ``n_dropped`` in a struct column ``line_dedup``.

    A line without a variable token (one with a digit) that stands in two
    documents recurs as it is, however short. For the others, lines with
    ``least`` tokens or more go down a tree of fixed depth: by their
    number of tokens, then by their ``depth`` leading tokens. Within a leaf, a later token is fixed if at
    least ``min_docs`` lines (equal ones once per document) have it at its
    place, and variable otherwise. The line's template is its fixed tokens with
    the rest generalised; one with a share of ``similarity`` fixed tokens that
    lines of ``min_docs`` documents follow is recurring. Recurring lines are
    dropped from all documents but the first (smallest identifier, then text), so that
    of a text with many copies one stays whole. With ``spare``, so does a text
    that would keep no word: it repeats others as a whole.

    Other lines, blank ones too, stay as they are. A null text has no line and
    stays null; rows that repeat identifier and text are one document. Every
    grouping is combined before its shuffle, by form first, so a line in a third
    of all documents is one row per task.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(order_id(ident).alias("k"), text_key(text).alias("h"), F.col(text).alias("t"))
    every = stored(line_rows(rows, depth), "line-rows")  # parsed once
    own, templates = recurring(every, min_docs, depth, similarity, least)
    drop = (own.join(templates.select("template", "pattern", "origin"), ["template", "pattern"]).filter(F.struct("k", "h") != F.col("origin"))
            .select("k", "h", "form").unionByName(repeated_lines(every)).groupBy("k", "h").agg(F.collect_set("form").alias("forms")))
    keyed = docs.select(F.struct("*").alias("row"), order_id(ident).alias("k"), text_key(text).alias("h"))

    @F.pandas_udf("n_lines long, n_dropped long, text string")
    def cleaned(texts: pd.Series, forms: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(clean(list(zip(texts, forms)), depth, spare), columns=["n_lines", "n_dropped", "text"])

    found = keyed.join(drop, ["k", "h"], "left").select("row", cleaned(F.col("row")[text], F.col("forms")).alias("found"))
    columns = [F.col("found.text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns, F.struct("found.n_lines", "found.n_dropped").alias("line_dedup"))
