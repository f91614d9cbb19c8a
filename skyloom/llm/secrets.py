"""Secrets in texts: fixed patterns, and strings that a public vocabulary can't shorten."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_strings, map_texts

# fixed values of the contract; letters of the keywords may be in either case
ASSIGN = re.compile(r"(?P<k>(?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?(?P<v>[A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that is too short has no longer one inside, so this equals run and filter
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
# fixed values: sizes of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 digests in hexadecimal
DIGEST_SIZES = frozenset({32, 40, 56, 64, 96, 128})
IDENTIFIER = re.compile(r"[0-9]+|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
JOINED = re.compile(r"[A-Za-z_/=+-]+[0-9]{0,4}")  # words in a row, perhaps with a short number
PART = re.compile(r"[A-Za-z]{3,}")
ONLY_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, found array<string>"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary at ``path``, loaded once per Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def is_known(value: str) -> bool:
    """Digests and identifiers, which are random by nature but give nothing away."""
    return bool(IDENTIFIER.fullmatch(value)) or (len(value) in DIGEST_SIZES and bool(ONLY_HEX.fullmatch(value)))


def inefficient(value: str, encode, ratio: float) -> bool:
    return len(value) < ratio * len(encode(value))


def random_letters(value: str, encode, ratio: float, letters: float) -> bool:
    """Whether joined letters are no words: a part as long as a candidate is under ``letters``, or the run is inefficient and its parts together are.

    Parts of one or two letters can't be judged; a run that is mostly such parts is taken for an identifier.
    """
    parts = PART.findall(value)
    if any(len(p) >= 16 and inefficient(p, encode, letters) for p in parts):
        return True
    size = sum(map(len, parts))
    return 2 * size >= len(value) and inefficient(value, encode, ratio) and size < letters * sum(len(encode(p)) for p in parts)


def scan(text: str, encode, ratio: float, letters: float = 2.0) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans ``(start, kind, end)`` in order, and the spans that the token-efficiency test adds."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m["v"]) >= 6]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if is_known(value) or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if random_letters(value, encode, ratio, letters) if JOINED.fullmatch(value) else inefficient(value, encode, ratio):
            added.append((m.start(), m.end()))
    return base, added


def find_secrets(docs: DataFrame, vocabulary: str | None = None, ratio: float = 2.2, ident: str = "doc_id",
                 text: str = "text", letters: float = 2.0) -> DataFrame:
    """One row per document with the secrets of its whole text (null: empty).

    Base spans are keyword assignments, access keys and long hexadecimal runs.
    The token-efficiency test looks at runs of 16 or more characters of keys:
    ordinary words shorten to few tokens, while a random string has under
    ``ratio`` characters for each token of the vocabulary. Letters only, and
    letters joined by separators with up to four digits at the end, are random
    if they are under the stricter ``letters``, judged by their parts (see
    ``random_letters``), as long words of rare languages come near ``ratio``.
    Digests of known sizes, UUIDs, plain numbers and runs that a base span
    overlaps are left out. ``spans`` lists all spans by
    start, then kind (assign, access, hex, random), in code points with the end
    exclusive. Repeated rows give repeated results; other columns are not read.
    """
    path = vocabulary or vocabulary_path()

    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        encode = encoding(path).encode_ordinary
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans", "found")}
            for value in as_strings(part["t"]):
                base, added = scan(value, encode, ratio, letters)
                spell = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in xs)
                every = sorted(base + [(s, 3, e) for s, e in added])
                for kind, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(k == kind for _, k, _ in base))
                out["n_random"].append(len(added))
                out["base_sha256"].append(hashlib.sha256(spell(base).encode()).hexdigest())
                out["spans"].append(spell(every))
                out["found"].append([value[s:e] for s, _, e in every])
            yield {"doc_id": part["d"], **out}

    return map_texts(docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t")), run, SCHEMA)
