"""SQL twins of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

from .quality import BOILERPLATE, NAVIGATION, SYMBOLS

_SPACE = r"[ \t\n\x0B\x0C\r]"
_WORDS = f"list_filter(regexp_split_to_array({{0}}, '{_SPACE}+'), lambda w: w <> '')"


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values)) + "]"


def _count(text: str, chars: str) -> str:
    return f"(length({text}) - length(translate({text}, '{chars}', '')))"


ARCHIVE = """
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN again THEN first_id END AS refers_to
    FROM (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again
          FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                       min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS first_id FROM pages))"""

QUALITY = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, {_WORDS.format('t')} AS ws FROM d),
    g AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 6)),
    twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
    rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2, 3, 4]) AS p FROM twice) GROUP BY 1),
    l AS (SELECT r, i, line, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS x FROM
          (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)),
    b AS (SELECT r, x, line, {_WORDS.format('x')} AS xs, lower(x) AS low FROM l WHERE x <> ''),
    n AS (SELECT *, list_filter(list_transform(xs, lambda v: lower(regexp_replace(v, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'))), lambda v: v <> '') AS named FROM b),
    f AS (SELECT r, line, length(x) AS size,
          len(named) >= 2 AND list_bool_and(list_transform(named, lambda v: list_contains({_quoted(NAVIGATION)}, v)))
          OR list_bool_or(list_transform({_quoted(BOILERPLATE)}, lambda p: contains(low, p)))
          OR xs[-1] = '|' OR {_count('x', SYMBOLS)} > 0.1 * list_sum(list_transform(xs, lambda v: length(v)))
          OR len(xs) >= 8 AND NOT regexp_matches(x, '[.!?…。！？:;]') AS fails FROM n),
    s AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS n_failed,
          sum(size) AS whole, sum(CASE WHEN fails THEN size ELSE 0 END) AS lost FROM f GROUP BY 1),
    m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) AS BIGINT) AS word_chars,
          {_count('t', SYMBOLS)} AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(whole, 0) AS whole,
          coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed_lines
          FROM w LEFT JOIN s USING (r) LEFT JOIN rep USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT base AND 2 * lost <= whole AS kept, n_lines, n_failed_lines
    FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base FROM m)"""

LINES = f"""
    WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
    t AS (SELECT *, list_transform({_WORDS.format('line')}, lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '<*>' ELSE w END) AS ts FROM l),
    p AS (SELECT *, array_to_string(ts, ' ') AS form, len(ts) || chr(9) || array_to_string(ts[1:3], chr(9)) AS leaf FROM t WHERE len(ts) > 0),
    whole AS (SELECT DISTINCT doc_id, leaf, form, ts FROM p),
    own AS (SELECT * FROM whole WHERE len(ts) >= 3),
    shared AS (SELECT leaf FROM own GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
    forms AS (SELECT leaf, form, any_value(ts) AS ts, count(*) AS n FROM own SEMI JOIN shared USING (leaf) GROUP BY 1, 2),
    cells AS (SELECT leaf, form, n, unnest(ts) AS w, generate_subscripts(ts, 1) AS pos FROM forms),
    marked AS (SELECT leaf, form, pos, w, w <> '<*>' AND (pos <= 3 OR sum(n) OVER (PARTITION BY leaf, pos, w) >= 5) AS fixed FROM cells),
    named AS (SELECT leaf, form, string_agg(CASE WHEN fixed THEN w ELSE '<*>' END, ' ' ORDER BY pos) AS pattern FROM marked GROUP BY 1, 2
              HAVING avg(CASE WHEN fixed THEN 1 ELSE 0 END) >= 0.7),
    used AS (SELECT leaf, pattern, count(DISTINCT doc_id) AS n, min(doc_id) AS origin FROM own JOIN named USING (leaf, form) GROUP BY 1, 2 HAVING n >= 5),
    exact AS (SELECT form, min(doc_id) AS origin FROM whole WHERE NOT list_contains(ts, '<*>') GROUP BY 1 HAVING count(*) > 1),
    gone AS (SELECT doc_id, leaf, form FROM own JOIN named USING (leaf, form) JOIN used USING (leaf, pattern) WHERE doc_id <> origin
             UNION SELECT doc_id, leaf, form FROM whole JOIN exact USING (form) WHERE doc_id <> origin),
    kept AS (SELECT l.doc_id, l.i, l.line, g.form IS NOT NULL AS dropped FROM l LEFT JOIN p USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.leaf = p.leaf AND g.form = p.form)
    SELECT doc_id, CASE WHEN any_value(text) IS NULL OR any_value(text) = '' THEN 0 ELSE count(*) END AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
           CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(kept.line, chr(10) ORDER BY i) FILTER (NOT dropped), '') END AS text
    FROM kept JOIN d USING (doc_id) GROUP BY doc_id"""

SPANS = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    raw AS (SELECT doc_id, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '[^.!?\n]*(?:[.!?]+|\n)|[^.!?\n]+') AS ps FROM d)),
    worded AS (SELECT *, regexp_extract_all(lower(s), '[\p{L}\p{N}_]+') AS ws FROM raw),
    placed AS (SELECT *, greatest(1, sum(CASE WHEN len(ws) > 0 OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM worded),
    sent AS (SELECT doc_id, CAST(n AS BIGINT) - 1 AS n, CAST(sum(length(s)) AS BIGINT) AS size, string_agg(s, '' ORDER BY i) AS s, coalesce(string_agg(array_to_string(ws, ' '), ' ' ORDER BY i) FILTER (len(ws) > 0), '') AS words,
             CAST(sum(len(ws)) AS BIGINT) AS k FROM placed GROUP BY doc_id, n),
    cum AS (SELECT *, CAST(sum(k) OVER w AS BIGINT) AS upto, CAST(sum(size) OVER w AS BIGINT) AS stop FROM sent WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
    fit AS (SELECT a.doc_id, a.n AS first, b.n AS last FROM cum a JOIN cum b ON a.doc_id = b.doc_id AND b.n BETWEEN a.n AND a.n + 41
            AND (b.upto - a.upto + a.k >= 40 OR b.upto - a.upto + a.k >= 20 AND b.n - a.n >= 2)),
    ends AS (SELECT doc_id, first, min(last) AS last FROM fit GROUP BY 1, 2 UNION SELECT doc_id, max(first), last FROM fit GROUP BY 1, 3
             UNION SELECT doc_id, 0, max(n) FROM cum GROUP BY 1 HAVING sum(k) BETWEEN 1 AND 39 AND NOT (sum(k) >= 20 AND count(*) >= 3)),
    run AS (SELECT e.doc_id, first, last, string_agg(c.words, ' ' ORDER BY c.n) AS body FROM ends e JOIN cum c ON c.doc_id = e.doc_id AND c.n BETWEEN first AND last GROUP BY 1, 2, 3),
    again AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, first) > 1),
    gone AS (SELECT DISTINCT a.doc_id, c.n FROM again a JOIN cum c ON c.doc_id = a.doc_id AND c.n BETWEEN first AND last),
    every AS (SELECT c.*, g.n IS NOT NULL AS removed FROM cum c LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.n = c.n)
    SELECT d.doc_id, count(e.n) AS n_sentences, coalesce(CAST(sum(CASE WHEN removed THEN 1 ELSE 0 END) AS BIGINT), 0) AS n_removed,
           coalesce(string_agg(CAST(stop - size AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY n) FILTER (removed), '') AS removed,
           coalesce(string_agg(s, '' ORDER BY n) FILTER (NOT removed), '') AS text
    FROM d LEFT JOIN every e ON d.doc_id = e.doc_id GROUP BY d.doc_id"""

NEGATIVES = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id)::INTEGER AS rank,
       n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) <= 3
"""
