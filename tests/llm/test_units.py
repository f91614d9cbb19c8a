"""Helpers of the corpus operators against plain reimplementations."""

import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from skyloom.llm import decontamination, language, packing, quality, secrets, simhash, spans, warc
from tests_llm_plain import plain_fingerprint, plain_measure, plain_secrets

EDGE_TEXTS = ["", " ", "\n\n", "a", "a b", "a b c", "A B c\x85d e", "é É ß", "x" * 5000, "one two three " * 400, "\x00 \x1f ￿ 😀 b",
              "a\tb\rc\x0bd\x0ce", "的 文 字", "It's <|endoftext|> don't <|X"]


@pytest.mark.parametrize("text", EDGE_TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_trie_links_are_all_near_pairs():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2 ** 62, 60, dtype=np.uint64))
    near = keys ^ (np.uint64(1) << rng.integers(0, 64, len(keys)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(keys)).astype(np.uint64))
    keys = np.unique(np.concatenate([keys, near]))
    one, n = np.zeros(1, np.int64), np.full(1, len(keys))
    for most in (1 << 19, 7):
        got = {(min(a, b), max(a, b)) for x, y in simhash.trie_links(keys, one, n, one, n, one, 0, most=most) for a, b in zip(x.tolist(), y.tolist())}
        want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if int(keys[i] ^ keys[j]).bit_count() <= 3}
        assert got == want and want


def test_quality_counts():
    random.seed(5)
    texts = EDGE_TEXTS + [" ".join(random.choices("ab", k=random.randint(0, 25))) + random.choice(["", "\n", " |"]) * 3 for _ in range(300)]
    for text in texts:
        found = quality.measure(text)
        assert {k: found[k] for k in plain_measure(text)} == plain_measure(text), text


def test_quality_rules():
    prose = "The cat sat on the mat and looked at the dog. It was warm."
    assert quality.measure(prose)["kept"]
    assert not quality.line_fails(prose)
    assert quality.line_fails("Home | About | Contact") and quality.line_fails("All rights reserved.") and quality.line_fails("a | b |")
    assert quality.line_fails("one two three four five six seven eight nine")
    mixed = quality.measure(prose + "\nAll rights reserved.")
    assert mixed["kept"] and mixed["cleaned"] == prose and mixed["n_failed_lines"] == 1
    assert not quality.measure("Home About Login\n" * 3 + "Fine. text. here. and. some. more. words.")["kept"]


def test_secret_base_spans_and_efficiency():
    encode = secrets.encoding(secrets.vocabulary_path()).encode_ordinary
    random.seed(2)
    pieces = ["token=token:abcdefgh", "API_KEY: 'x1y2z3'", "AKIA" + "A1" * 8, "AKIAKIA" + "B" * 20, "AKIA12", "ab" * 12, "0f" * 11 + "0", "é😀 ", "paſsword=abcdefg",
              "secret = short", "passwd='abc.def=/x'", " ", "xyz", "\n", "password password=1234567"]
    for _ in range(500):
        text = "".join(random.choices(pieces, k=random.randint(0, 8)))
        assert secrets.scan(text, encode, 2.2)[0] == plain_secrets(text)
    base, added = secrets.scan("see Xq7Lw9Zt2Rv5Kp8Nb4Jm here", encode, 2.2)
    assert not base and added == [(4, 24)]
    for innocent in ("0123456789012345678901", "550e8400-e29b-41d4-a716-446655440000", "extraordinarilylongwords", "2012-hello-world-and-more", "some_long_name_2024"):
        assert not secrets.scan(innocent, encode, 2.2)[1], innocent


def test_random_letters_are_secrets():
    encode = secrets.encoding(secrets.vocabulary_path()).encode_ordinary
    rng = random.Random(5)
    for letters, least in ((string.ascii_letters, 0.99), (string.ascii_uppercase, 0.99), (string.ascii_lowercase, 0.95)):
        for make in (lambda own: own, lambda own: own[:11] + "/" + own[11:] + "42", lambda own: own[:14] + "+" + own[14:] + "==", lambda own: "configuration/production/" + own):
            found = 0
            for _ in range(300):
                value = make("".join(rng.choices(letters, k=30)))
                base, added = secrets.scan(f"see {value} here", encode, 2.2)
                found += not base and added == [(4, 4 + len(value))]
            assert found >= least * 300, (letters, found)
    for innocent in ("internationalization", "getUserNameFromIdentifier", "INTERNATIONALIZATION", "MAX_CONNECTION_TIMEOUT_SECONDS", "com/example/project/Main",
                     "Donaudampfschifffahrtsgesellschaft", "i_am_a_b_c_d_e_f_g", "a-b-c-d-e-f-g-h-i-j", "=" * 40, "get-user-name-from-id-2024", "__init__/__main__"):
        assert not secrets.scan(innocent, encode, 2.2)[1], innocent


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    texts = EDGE_TEXTS + ["don't WON'T 123 4.5 ...!?", "ΑΣ ΣΑΣ İ K é é", "\xa0 x\xa0y  z", "<|ENDOFTEXT|> a", "Déjà-vu, naïve; œuvre."]
    for room in (10, 10 ** 6):
        tokens = packing.WordTokens(packing.vocabulary_path(), room)
        for _ in range(2):
            for text, got in zip(texts, tokens.encode([t.encode() for t in texts])):
                assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_plan_uses_all_pieces_and_fills_exact_complements():
    random.seed(4)
    for _ in range(1500):
        room = random.randint(2, 30)
        lengths = Counter(random.choices(range(1, room + 1), k=random.randint(0, 70)))
        made, used = packing.plan(lengths, room), Counter()
        for inside, n in made:
            assert 0 < sum(inside) <= room and n > 0
            for size in inside:
                used[size] += n
        assert used == lengths
        least = -(-sum(k * n for k, n in lengths.items()) // room)
        assert least <= sum(n for _, n in made) <= max(least, 1.5 * least + 1)
    assert packing.plan({7: 5, 3: 5}, 10) == [((7, 3), 5)]
    assert packing.plan({6: 3, 3: 3, 1: 3}, 10) == [((6, 3, 1), 3)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    places = packing.slots([((4, 3), 2), ((3, 3), 1)])
    assert [x.tolist() for x in places[3]] == [[0, 2, 3], [0, 2, 2], [4, 0, 3]]


def longest_common(p, t, open_p, open_t):
    best = []
    for i in range(len(p)):
        for j in range(len(t)):
            n = 0
            while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and open_p[i + n] and open_t[j + n]:
                n += 1
            best.append((n, i, j))
    return max(best, key=lambda b: b[0], default=(0, 0, 0))


def test_tiles_are_greedy_and_common():
    random.seed(8)
    for _ in range(300):
        p, t = random.choices(range(4), k=random.randint(0, 25)), random.choices([-1, 0, 1, 2, 3], k=random.randint(0, 30))
        tiles = decontamination.tile(p, t, 2, start=random.choice([2, 5, 20]))
        seen_p, seen_t = set(), set()
        for i, j, n in tiles:
            assert n >= 2 and p[i:i + n] == t[j:j + n] and -1 not in t[j:j + n]
            assert not seen_p & set(range(i, i + n)) and not seen_t & set(range(j, j + n))
            seen_p |= set(range(i, i + n))
            seen_t |= set(range(j, j + n))
        open_p, open_t = [i not in seen_p for i in range(len(p))], [j not in seen_t and t[j] >= 0 for j in range(len(t))]
        assert longest_common(p, t, open_p, open_t)[0] < 2  # nothing long enough is left
        if tiles:
            assert max(n for *_, n in tiles) == longest_common(p, t, [True] * len(p), [v >= 0 for v in t])[0]
    assert sum(n for *_, n in decontamination.tile([1, 2, 3, 4, 5, 6], [4, 5, 6, -1, 1, 2, 3], 3)) == 6  # reordered


def test_sentences_cover_the_text_and_runs_are_shortest():
    for text in EDGE_TEXTS + ["One two. Three! Four?\n\nFive... six", ". . a. "]:
        parts = spans.sentences(text)
        assert "".join(text[a:b] for a, b, _ in parts) == text
        size = [len(w) for *_, w in parts]
        full = {(a, b): sum(size[a:b + 1]) >= 5 or sum(size[a:b + 1]) >= 3 and b > a for a in range(len(size)) for b in range(a, len(size))}
        want = {min(r for r in full if full[r] and r[0] == a) for a in range(len(size)) if any(full[r] for r in full if r[0] == a)}
        want |= {max(r for r in full if full[r] and r[1] == b) for b in range(len(size)) if any(full[r] for r in full if r[1] == b)}
        if not want and sum(size):
            want = {(0, len(size) - 1)}
        got = [(a, b) for a, b, _ in spans.runs(parts, 2, 3, 5)]
        assert len(got) == len(set(got)) and set(got) == want


def test_network_gradient():
    rng = np.random.default_rng(1)
    net = language.initial(["a", "b"], 3, rng)
    x = rng.integers(97, 101, (5, 4)).astype(np.uint8)
    x[-1, 0] = language.PAD
    weight = rng.normal(size=(5, 3, 4)).astype(np.float32)
    table, own = net.inputs[0].astype(np.float64), net.states[0].astype(np.float64)
    states, trace = language._gates(table.astype(np.float32), own.astype(np.float32), x, True)
    d_table, d_own = language._back(table.astype(np.float32), own.astype(np.float32), x, trace, weight)

    def loss(a, b):
        return float((language._gates(a.astype(np.float32), b.astype(np.float32), x, False) * weight).sum())

    for k, i in ((0, 97), (4, 98), (7, 99), (8, 100)):
        step = np.zeros_like(table)
        step[k, i] = 1e-2
        assert abs((loss(table + step, own) - loss(table - step, own)) / 2e-2 - d_table[k, i]) < 2e-2
    for k, i in ((0, 0), (5, 1), (8, 2)):
        step = np.zeros_like(own)
        step[k, i] = 1e-2
        assert abs((loss(table, own + step) - loss(table, own - step)) / 2e-2 - d_own[k, i]) < 2e-2


def test_pooled_probabilities_are_means_over_positions():
    net = language.initial(["a", "b", "c"], 4, np.random.default_rng(0))
    texts = [b"", b"x", bytes(range(97, 120)) * 9, b"ab" * 40]
    got = language.pooled(net, texts, window=16, at_once=3)
    assert got[0].tolist() == [0, 0, 0] and np.allclose(got[1:].sum(axis=1), 1, atol=1e-5)
    for text, p in zip(texts[1:], got[1:]):
        each = []
        for at in range(0, len(text), 16):
            own = text[at:at + 16].ljust(16, bytes([language.PAD]))
            each.append(language.positions(net, np.frombuffer(own, np.uint8)[:, None])[:len(text[at:at + 16]), :, 0])
        assert np.allclose(np.concatenate(each).mean(axis=0), p, atol=1e-5)


def test_records_round_trip():
    for args in ((5, "http://a/b c\r\n", b"x\r\n\r\ny", 6, None), (None, None, b"", 0, None), (9, "u", None, 300, 3)):
        page, url, payload, size, first = args
        import hashlib
        digest = hashlib.sha256(payload or b"").hexdigest()
        name, kind, data = warc.encode_record(page, url, payload, size, digest, first, "2024-01-01T00:00:00Z")
        row, end = warc.decode_record(b"xx" + data, 2)
        assert end == len(data) + 2 and row["record_id"] == name and row["record_type"] == kind == ("revisit" if first else "response")
        assert (row["page_id"], row["refers_to"], row["payload_bytes"], row["payload"]) == (page, first, size, payload)


def test_held_out_uses_crc32(spark):
    rows = [(i,) for i in [*range(50), -7, None]]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long").select("doc_id", language.held_out()).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for (i,) in rows}


