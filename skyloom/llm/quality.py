"""Line-first cleaning and the counts that quality rules use."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, as_strings, map_texts

# fixed values of the contract
SYMBOLS = "#*$%&|<>"
# fixed values of the rules: words of menus and of boilerplate in the languages of web pages
NAVIGATION = frozenset("home menu login logout register search contact about sitemap next previous share tweet subscribe print".split())
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use cookies", "javascript",
               "licensed under", "released under", "lorem ipsum")
MARKS = re.compile("[.!?…。！？:;]")

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
           "n_lines long, n_failed_lines long, cleaned string")
_EDGES = re.compile(r"^\W+|\W+$")


def line_fails(line: str, symbol_share: float = 0.1, run_on_words: int = 8) -> bool:
    """Whether one line that has a word breaks a rule.

    * navigation: two words or more, every one of them a menu word or a bare separator;
    * boilerplate: a phrase of legal notices or script warnings;
    * table or menu row: it ends in a separator ``|``, or a tenth of its characters are symbols;
    * punctuation: ``run_on_words`` words or more and no mark that ends a sentence or clause anywhere, as in lists of links.
    """
    words = line.split() or [line]
    bare = [_EDGES.sub("", w).lower() for w in words]
    named = [w for w in bare if w]
    if len(named) >= 2 and all(w in NAVIGATION for w in named):
        return True
    low = line.lower()
    if any(p in low for p in BOILERPLATE):
        return True
    symbols = sum(line.count(c) for c in SYMBOLS)
    if words[-1] == "|" or symbols > symbol_share * sum(map(len, words)):
        return True
    return len(words) >= run_on_words and not MARKS.search(line)


def measure(text: str, most_lost: float = 0.5) -> dict:
    """The counts of one whole text, its cleaned lines and the verdict."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    repeated = 0
    if n > 5:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        windows = [joined[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], ends[4:])]
        if len(set(windows)) < len(windows):
            counts, covered = Counter(windows), 0
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeated += i + 5 - max(covered, i)
                    covered = i + 5
    lines = text.split("\n")
    worded = [x for x in lines if x.strip(SPACE)]
    kept_lines, failed, lost, whole = [], 0, 0, 0
    for line in lines:
        size = len(line.strip(SPACE))
        whole += size
        if size and line_fails(line.strip(SPACE)):
            failed += 1
            lost += size
        else:
            kept_lines.append(line)
    base = n < 10 or 100 * repeated > 20 * n
    return {"n_words": n, "word_chars": len(text) - sum(text.count(c) for c in SPACE), "n_symbols": sum(text.count(c) for c in SYMBOLS),
            "n_dup_lines": len(worded) - len(set(worded)), "n_repeat_words": repeated, "base_failed": base,
            "kept": not base and lost <= most_lost * whole, "n_lines": len(worded), "n_failed_lines": failed, "cleaned": "\n".join(kept_lines)}


def clean_lines(docs: DataFrame, ident: str = "doc_id", text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """One row per document: counts over its whole text, the text without failed lines, and whether it is kept.

    Rules are applied to lines first (see ``line_fails``). A document whose
    failed lines hold more than ``most_lost`` of its characters is rejected, as
    is one with under 10 words or with over a fifth of its words in repeated
    5-word windows. Null and empty texts have no words and are rejected; repeated
    rows give repeated results; other columns are not read.
    """
    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            found = [measure(t, most_lost) for t in as_strings(part["t"])]
            yield {"doc_id": part["d"], **{k: [f[k] for f in found] for k in (found[0] if found else {})}}

    return map_texts(docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t")), run, "doc_id long, " + METRICS)
