"""Brute-force versions that several tests use."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def passes_luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_personal(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        own = []
        for m in re.finditer(pattern, text):
            number = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(number) <= 19 and passes_luhn(number) or kind == "phone" and 8 <= len(number) <= 15):
                own.append(f"{kind}:{m.start()}:{m.end()}")
        found.append(own)
    spans = ",".join(s for own in found for s in own)
    return tuple(map(len, found)), hashlib.sha256(spans.encode()).hexdigest(), spans


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
         ("card", r"[0-9](?:[\x20-]?[0-9]){15,}"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_words(text):
    for _, pattern in KINDS:
        text = re.sub(pattern, " ", text)
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if regex.search(r"\p{L}", w)]


def plain_disclosure(docs, reach=8, generalise=0.8, remove=0.95):
    """``(doc_id, spans)``: base spans and telling terms, counted in dictionaries over all distinct texts."""
    texts = {t for _, t in docs}
    holders, beside, having, own = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for t in texts:
        for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()):
            having[w].add(t)
        _, _, base = plain_personal(t)
        for kind, pattern in KINDS:
            hits = list(re.finditer(pattern, t))
            edges = [0, *(x for m in hits for x in m.span()), len(t)]
            for n, m in enumerate(hits):
                if f"{kind}:{m.start()}:{m.end()}" not in base.split(","):
                    continue
                number = re.sub("[^0-9]", "", m[0])
                group = {"email": m[0].split("@")[-1].lower(), "ip": ".".join(m[0].split(".")[:2]), "card": number[:6], "phone": number[:4]}[kind]
                before, after = (plain_words(t[a:b]) for a, b in (edges[2 * n:2 * n + 2], edges[2 * n + 2:2 * n + 4]))
                for c in ((kind, m[0].lower() if kind in ("email", "ip") else number), (kind, "block", group)):
                    holders[c].add(t)
                    for w in {*before[-reach:], *after[:reach]}:
                        beside[c, w].add(t)
    n = len(texts)
    for (c, w), where in beside.items():
        n_t, n_c, information = max(len(having[w]), len(where)) + 1, len(holders[c]), math.log2(n / len(holders[c]))
        if information > 0 and math.log2(n * len(where) / (n_t * n_c)) / information >= generalise:
            strength = math.log2(n * len(where) / (n_t * n_c)) / information
            for t in where:
                own[t].add((w, strength))
    out = []
    for i, t in docs:
        told, blank = defaultdict(float), t
        for w, strength in own[t]:
            told[w] = max(told[w], strength)
        for _, pattern in KINDS:
            blank = re.sub(pattern, lambda m: " " * len(m[0]), blank)
        hits = [(told[m[0].lower()] >= remove, m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", blank) if m[0].lower() in told]
        extra = [f"{'removed' if gone else 'general'}:{a}:{b}" for gone, a, b in sorted(hits)]
        out.append((i, ",".join([*filter(None, [plain_personal(t)[2]]), *extra])))
    return out


def plain_measure(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeated = len({j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)})
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": repeated,
            "base_failed": len(words) < 10 or 100 * repeated > 20 * len(words)}


def plain_secrets(text):
    out = []
    for m in re.finditer(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)
