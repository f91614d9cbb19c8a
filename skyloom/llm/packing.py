"""Packing token sequences by exact complements, then best fit.

Only the histogram of piece lengths decides how pieces go together: it has one
count per length, at most ``capacity`` of them whatever the corpus holds. The
plan made from it is a list of patterns (which lengths share a sequence) with
multiplicities, and Spark hands the slots of the plan to the pieces by their
rank among pieces of equal length.
"""

from __future__ import annotations

import functools
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import as_bytes, map_texts, stored

CAPACITY = 2048
END_OF_TEXT = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
# what the vocabulary's splitter makes of words that have only these characters and no apostrophe: letters, single digits, other runs
_PLAIN = re.compile("[!-&(-@\\[-~ß-öø-ÿ]+")
_PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class WordTokens:
    """Token ids of texts as little-endian bytes, through a table of known words.

    The vocabulary splits texts at white space before it merges, so a text's
    ids are those of its words in a row. Words are looked up with ASCII letters
    in lower case, which the vocabulary does itself, unless the text has the
    beginning of a special token. Unknown words are encoded together and told
    apart by the tokens that end a piece. When a generation of the table is full
    (``room`` bytes of words, ids and entries), it becomes the older one, which
    is dropped at the next time; words that are met again move to the new one.
    So the table has at most two generations, and cold words go first.
    """

    ENTRY = 200  # bytes of two Python objects and their place in a dictionary

    def __init__(self, path: str, room: int = 80 << 20):
        from tokenizers import Tokenizer

        self.tokenizer, self.room, self.known, self.older, self.used = Tokenizer.from_file(path), room, {}, {}, 0
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def learn(self, words: list[bytes]) -> None:
        plain, counts = [], []
        for w in words:
            word = w.decode("utf-8", "replace")
            if _PLAIN.fullmatch(word) and "<|" not in word:
                plain.append(word)
                counts.append(len(_PIECE.findall(word)))
            else:
                self.known[w] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        for at in range(0, len(plain), 500):
            some = plain[at:at + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            upto = (4 * (last[np.cumsum(counts[at:at + 500]) - 1] + 1)).tolist()
            raw, begin = ids.tobytes(), 0
            for word, end in zip(some, upto):
                self.known[word.encode()] = raw[begin:end]
                begin = end

    def encode(self, texts: list[bytes]) -> list[bytes]:
        words, cuts = [], [0]
        for t in texts:
            words += (t if b"<|" in t else t.lower()).split()
            cuts.append(len(words))
        found = list(map(self.known.get, words))
        if None in found:
            missing = [i for i, v in enumerate(found) if v is None]
            wanted = {words[i] for i in missing}
            again = {w: self.older[w] for w in wanted if w in self.older}
            self.known |= again
            self.learn([w for w in wanted if w not in again])
            self.used += sum(len(w) + len(self.known[w]) + self.ENTRY for w in wanted)
            for i in missing:
                found[i] = self.known[words[i]]
            if self.used > self.room:
                self.older, self.known, self.used = self.known, {}, 0
        return [b"".join(found[a:b]) for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One vocabulary per Python worker, kept between its tasks."""
    return WordTokens(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all texts, ranked within (task, length).

    A text is its token ids and one end mark; a longer one than ``capacity`` is
    cut into pieces of that many, of which the last may be shorter. A null text
    is empty: one piece of one token.
    """
    path, end = vocabulary or vocabulary_path(), np.array([END_OF_TEXT], "<u4").tobytes()

    def run(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        tokens, task, seen = word_tokens(path), TaskContext.get().partitionId(), Counter()
        for part in parts:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "local_rank")}
            for doc, ids in zip(part["d"].to_pylist(), tokens.encode(as_bytes(part["t"]))):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at:at + 4 * capacity]
                    size = len(own) // 4
                    for name, value in zip(out, (doc, k, at // 4, size, zlib.crc32(own), seen[size])):
                        out[name].append(value)
                    seen[size] += 1
            yield out | {"task": [task] * len(out["piece"])}

    return map_texts(docs.select(F.col(ident).cast("long").alias("d"), F.col(text).alias("t")), run, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``[(lengths of one sequence, how many such sequences)]`` that uses up the histogram.

    From the longest length down, a length looks up what would fill its gap
    exactly in the index of sums of one, two and three lengths, and as many
    sequences are made as the counts allow; the gap is looked up again until
    nothing fills it. What is left is placed by best fit, longest first: a piece
    goes where the least room stays. Both work on counts, so equal sequences
    cost one step.
    """
    left = {k: n for k, n in histogram.items() if n > 0}
    patterns: Counter[tuple[int, ...]] = Counter()
    sizes = sorted(left)

    def take(combo: tuple[int, ...]) -> bool:
        need = Counter(combo)
        if any(left.get(k, 0) < n for k, n in need.items()):
            return False
        times = min(left[k] // n for k, n in need.items())
        patterns[tuple(sorted(combo, reverse=True))] += times
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                sizes.pop(bisect_left(sizes, k))
        return True

    def two(total: int, most: int) -> tuple[int, int] | None:
        """The pair with the longest member, of available lengths up to ``most``."""
        for a in reversed(sizes[:bisect_left(sizes, min(most, total - 1) + 1)]):
            b = total - a
            if b > a:
                break
            if b in left and (a != b or left[a] > 1):
                return a, b
        return None

    for longest in range(capacity, 0, -1):
        while left.get(longest):
            gap = capacity - longest
            if gap == 0:
                take((longest,))
                continue
            if gap in left and (gap != longest or left[gap] > 1):
                take((longest, gap))
                continue
            left[longest] -= 1  # one is set aside, so that it isn't counted twice below
            pair = two(gap, longest)
            triple = None
            if pair is None:
                for a in reversed(sizes[:bisect_left(sizes, min(longest, gap - 2) + 1)]):
                    if 3 * a < gap:
                        break
                    if not left.get(a):
                        continue
                    left[a] -= 1
                    rest = two(gap - a, a)
                    left[a] += 1
                    if rest and all(left.get(k, 0) >= n for k, n in Counter((a, *rest)).items()):
                        triple = (a, *rest)
                        break
            left[longest] += 1
            if not (pair and take((longest, *pair)) or triple and take((longest, *triple))):
                break

    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room -> what is in -> how many
    rooms: list[int] = []

    def put(room: int, inside: tuple[int, ...], n: int) -> None:
        if room == 0:
            patterns[inside] += n
            return
        if not open_[room]:
            insort(rooms, room)
        open_[room][inside] = open_[room].get(inside, 0) + n

    for size in sorted(left, reverse=True):
        count = left[size]
        while count:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = capacity // size
                full, rest = divmod(count, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[at]
            inside, n = open_[room].popitem()
            if not open_[room]:
                rooms.pop(at)
            each = room // size
            full, rest = min(n, count // each), 0
            if full < n and count - full * each > 0 and full == count // each:
                rest = count - full * each
            if full:
                put(room - each * size, inside + (size,) * each, full)
            if rest:
                put(room - rest * size, inside + (size,) * rest, 1)
            if n - full - bool(rest):
                put(room, inside, n - full - bool(rest))
            count -= full * each + rest
    for of_room in open_.values():
        for inside, n in of_room.items():
            patterns[inside] += n
    return sorted(patterns.items(), reverse=True)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of slots, by rank."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter[int] = Counter()
    sequence = 0
    for inside, times in patterns:
        offset = 0
        for size in inside:
            runs[size].append((used[size], sequence, offset))
            used[size] += times
            offset += size
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in runs.items()}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every text with its place: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``.

    Sequences hold at most ``capacity`` tokens and have no gaps. Repeated rows
    are packed as often as they occur; other columns are not read. The driver
    gets one count per length and nothing of the pieces.
    """
    pieces = stored(cut_pieces(docs, vocabulary, capacity, ident, text), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = slots(plan(histogram, capacity))
    before = per_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"])

    def place(parts: Iterator[dict[str, pa.Array]]) -> Iterator[dict]:
        for part in parts:
            size = part["length"].to_numpy(zero_copy_only=False)
            rank = part["before"].to_numpy(zero_copy_only=False) + part["local_rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for k in np.unique(size):
                own = np.flatnonzero(size == k)
                first, base, place_ = where[int(k)]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = base[run] + rank[own] - first[run]
                offset[own] = place_[run]
            yield {**{c: part[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, "sequence_id": pa.array(sequence),
                   "offset": pa.array(offset)}

    return map_texts(ranked, place, PLACED, rows=10000)
