"""The registered queries and the pipeline on the smallest tables, against brute force over the whole tables."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from skyloom.llm import decontamination, language, lines, packing, secrets, spans
from skyloom.llm.common import order_id, stored, table, text_key
from skyloom.llm.queries import ORACLES, QUERIES
from tests_llm_plain import plain_disclosure, plain_fingerprint, plain_measure, plain_personal, plain_secrets

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, coalesce(text, ''), lang FROM '{SF_DIR}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="module")
def items():
    return duckdb.sql(f"SELECT item_id, text FROM '{SF_DIR}/benchmark.parquet'").fetchall()


def rows(spark, name):
    return QUERIES[name](spark, SF_DIR).collect()


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries()) and set(ORACLES) <= set(entry_module.oracle_sql())


def test_language_accuracy(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op2_language_id")}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in docs)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in docs if got[i]["held_out"] and lang]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def brute_spans(docs):
    seen = defaultdict(list)
    parts = {i: spans.sentences(t) for i, t, _ in docs}
    for i, *_ in docs:
        for first, last, digest in spans.runs(parts[i], 3, 20, 40):
            seen[digest].append((i, first, last))
    gone = defaultdict(set)
    for places in seen.values():
        for i, first, last in sorted(places)[1:]:
            gone[i] |= set(range(first, last + 1))
    return {i: ",".join(f"{parts[i][n][0]}:{parts[i][n][1]}" for n in sorted(gone[i])) for i, *_ in docs}


def test_substring_dedup(spark, docs):
    got = rows(spark, "op3_substring_dedup")
    assert {r["doc_id"]: r["removed"] for r in got} == brute_spans(docs) and any(r["n_removed"] for r in got)


def brute_groups(docs):
    prints = {i: plain_fingerprint(t) for i, t, _ in docs}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[b] < group[a]:
                    group[a], changed = group[b], True
    return {(i, f"{prints[i]:016x}", group[i]) for i in prints}


def test_near_duplicates(spark, docs):
    assert {tuple(r) for r in rows(spark, "op4_simhash_groups")} == brute_groups(docs)


def brute_lines(docs, min_docs=5, depth=3, similarity=0.7, least=3):
    own = {i: [lines.masked(x) for x in t.split("\n")] for i, t, _ in docs}
    leaf = lambda ts: (len(ts), *ts[:depth])
    forms = {i: {tuple(ts) for ts in own[i] if len(ts) >= least} for i in own}
    holders, cells = defaultdict(set), Counter()
    for i in forms:
        for f in forms[i]:
            holders[leaf(f)].add(i)
            cells.update((leaf(f), at, w) for at, w in enumerate(f) if at >= depth)
    names = {}
    for f in set().union(*forms.values()):
        if len(holders[leaf(f)]) >= min_docs:
            fixed = [w != lines.WILDCARD and (at < depth or cells[leaf(f), at, w] >= min_docs) for at, w in enumerate(f)]
            if sum(fixed) / len(f) >= similarity:
                names[f] = (leaf(f), tuple(w if ok else lines.WILDCARD for w, ok in zip(f, fixed)))
    users = defaultdict(set)
    for i in forms:
        for f in forms[i]:
            if f in names:
                users[names[f]].add(i)
    exact = defaultdict(set)
    for i in own:
        for ts in own[i]:
            if ts and lines.WILDCARD not in ts:
                exact[tuple(ts)].add(i)

    def drop(i, ts):
        u, e = users[names[tuple(ts)]] if tuple(ts) in names else (), exact[tuple(ts)]
        return len(u) >= min_docs and i != min(u) or len(e) > 1 and i != min(e)

    return {i: "\n".join(x for x in t.split("\n") if not drop(i, lines.masked(x))) for i, t, _ in docs}


def test_line_templates(spark, docs):
    got = rows(spark, "op5_line_templates")
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(docs) and any(r["n_dropped"] for r in got)


def test_personal_data(spark, docs):
    got = rows(spark, "op6_personal_data")
    assert {r["doc_id"]: r["spans"] for r in got} == dict(plain_disclosure([(i, t) for i, t, _ in docs])) and any(r["n_terms"] for r in got)
    for r in got:
        counts, digest, base = plain_personal(next(t for i, t, _ in docs if i == r["doc_id"]))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts and r["base_sha256"] == digest and r["spans"].startswith(base)


def test_secrets(spark, docs):
    text = {i: t for i, t, _ in docs}
    for r in rows(spark, "op7_secret_scan"):
        base = plain_secrets(text[r["doc_id"]])
        spelled = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spelled).encode()).hexdigest() and set(spelled) <= set(filter(None, r["spans"].split(",")) if spelled else ())


def check_packing(got, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    want, by = Counter(), defaultdict(list)
    for i, t in texts:
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at:at + 2048], "<u4")
            want[i, n, at, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in by.values():
        assert [o for o, _ in sorted(inside)] == [0, *np.cumsum([n for _, n in sorted(inside)])[:-1].tolist()] and sum(n for _, n in inside) <= 2048
    assert len(by) <= 1.03 * sum(n for inside in by.values() for _, n in inside) / 2048 + 1


def test_packing(spark, docs):
    check_packing(rows(spark, "op8_best_fit_packing"), [(i, t) for i, t, _ in docs])


def brute_leaks(docs, items):
    words, found = {}, {}
    for i, t, _ in docs:
        text = [words.setdefault(w, len(words)) for w in decontamination.tokens(t)]
        for item, passage in items:
            own = [words.setdefault(w, len(words)) for w in decontamination.tokens(passage)]
            if len({*zip(own, own[1:], own[2:], own[3:])} & {*zip(text, text[1:], text[2:], text[3:])}) and len(own) >= 4:
                share = sum(n for *_, n in decontamination.tile(own, text, 4)) / len(own)
                if share >= 0.5:
                    found.setdefault(i, []).append((share, -item))
    return {i: (len(v), -max(v)[1]) for i, v in found.items()}


def test_benchmark_leaks(spark, docs, items):
    got = rows(spark, "op9_benchmark_tiling")
    want = brute_leaks(docs, items)
    assert len(got) == len(docs) and {r["doc_id"]: (r["n_items"], r["item_id"]) for r in got if r["contaminated"]} == want
    assert {i for i, t, _ in docs for _, passage in items if passage in t} <= set(want)


def test_quality(spark, docs):
    text = {i: t for i, t, _ in docs}
    for r in rows(spark, "op10_quality_rules"):
        want = plain_measure(text[r["doc_id"]])
        assert {k: r[k] for k in want} == want and not (r["kept"] and r["base_failed"])


def test_archive_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    got = QUERIES["op1_warc_bundles"](spark, SF_DIR)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op1_warc_bundles']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_pipeline_stages(spark, items):
    """Each stage against brute force over what the stage before it kept."""
    now, columns = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "documents").columns
    plain = lambda frame: sorted((r["doc_id"], r["text"] or "", r["lang"]) for r in frame.collect())
    for name, stage in corpus_pipeline.STAGES:
        before, now = plain(now), stored(stage(spark, now, SF_DIR), name)
        if name == "best_fit_packing":
            check_packing(now.collect(), [(i, t) for i, t, _ in before])
            continue
        assert now.columns == columns
        after = plain(now)
        if name == "language_id":
            net = language.fit(table(spark, SF_DIR, "documents"), ~language.held_out())
            _, score = language.judge(net, [t.encode() for _, t, _ in before])
            assert after == [d for d, s in zip(before, score) if s >= corpus_pipeline.LEAST_SCORE] and len(after) > 0.9 * len(before)
        elif name == "line_templates":
            cleaned = brute_lines(before)
            assert after == sorted((i, cleaned[i] if cleaned[i].strip(" \t\n\x0b\x0c\r") else t, lang) for i, t, lang in before)
            assert any(cleaned[i] != t and not cleaned[i].strip() for i, t, _ in before) and any(a != b for a, b in zip(after, before))
        elif name == "simhash_near_duplicates":
            assert {i for i, *_ in after} == {c for *_, c in brute_groups(before)} and len(after) < len(before)
        else:
            leaks = brute_leaks(before, items)
            assert after == [d for d in before if d[0] not in leaks] and leaks


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    rows_ = [(1, "one two three four five", "en"), (1, "one two three four five", "en"), (2, "one two three four five", "en"), (None, "", None), (None, None, None),
             (7, "another text that stays here", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1, "x") for i, t, lang in rows_], "doc_id long, text string, lang string, source string, n_chars long, k string")
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, SF_DIR)
    assert got.columns == docs.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == [
        ("1", rows_[0][1]), ("7", rows_[5][1]), ("None", "")]
    assert docs.select(order_id(), text_key()).count() == 6


@pytest.mark.parametrize("k", range(5))
def test_stages_take_an_empty_table(spark, k):
    docs = table(spark, SF_DIR, "documents")
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), SF_DIR).count() == 0
