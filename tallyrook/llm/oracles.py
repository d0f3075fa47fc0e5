"""Queries of this subpackage in SQL that DuckDB runs over the same tables, where SQL has all
that the operator does: tokenizers and trained models it has not."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Base-32 of a digest of 20 bytes: 32 groups of five bits.
_BASE32 = "list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(bits[5 * i + 1 : 5 * i + 5]::BIT AS INTEGER), 1)), 'string_agg', '')"

WARC = f"""WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
d AS (SELECT body, octet_length(encode(body)) AS n, unhex(sha1(body))::BIT::VARCHAR AS bits, min(page_id) AS first FROM p GROUP BY body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN d USING (body)"""

_PIECE = "'<|' || COALESCE(x.role, '') || '|>' || chr(10) || COALESCE(x.text, '') || '<|end|>' || chr(10)"
_SPANS = """list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN {{'start': CAST(COALESCE(list_sum(list_transform({0}[1 : i - 1], lambda x: length({1}))), 0) + length({0}[i].role) + 5 AS INTEGER),
  'end': CAST(list_sum(list_transform({0}[1 : i], lambda x: length({1}))) AS INTEGER)}} END), lambda s: s IS NOT NULL)"""
_TEXT = "COALESCE(list_aggregate(list_transform({0}, lambda x: {1}), 'string_agg', ''), '')"

PREFERENCE = f"""WITH t AS (SELECT DISTINCT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS good, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT pair_id, COALESCE(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE good), []) AS c, COALESCE(list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn, role, text) FILTER (WHERE NOT good), []) AS r FROM t GROUP BY pair_id),
k AS (SELECT *, least(len(c), len(r)) AS least FROM s),
m AS (SELECT *, COALESCE(list_min(list_filter(range(1, least + 1), lambda i: c[i].role IS DISTINCT FROM r[i].role OR c[i].text IS DISTINCT FROM r[i].text)) - 1, least) AS common FROM k),
x AS (SELECT pair_id, common, c[1 : common] AS p, c[common + 1 :] AS a, r[common + 1 :] AS b, len(c) > 0 AS has_c, len(r) > 0 AS has_r FROM m)
SELECT pair_id, CAST(common AS BIGINT) AS common_turns, {_TEXT.format("p", _PIECE)} AS prompt, CASE WHEN has_c THEN {_TEXT.format("a", _PIECE)} END AS chosen, CASE WHEN has_r THEN {_TEXT.format("b", _PIECE)} END AS rejected,
  CASE WHEN has_c THEN {_SPANS.format("a", _PIECE)} END AS chosen_spans, CASE WHEN has_r THEN {_SPANS.format("b", _PIECE)} END AS rejected_spans FROM x"""

EMBEDDINGS = """WITH RECURSIVE f AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
v AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u, e FROM f WHERE fine),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, COALESCE(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN comp ON comp.a = vec_id"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
x AS (SELECT doc_id, hash(unnest(sh)) AS h FROM s),
sets AS (SELECT doc_id, n, list_sort(list(h)) AS key FROM x JOIN n USING (doc_id) GROUP BY ALL),
cls AS (SELECT key, n, min(doc_id) AS node FROM sets GROUP BY ALL),
t AS (SELECT node, n, unnest(key) AS h FROM cls),
often AS (SELECT h, count(*) AS df FROM t GROUP BY h HAVING count(*) > 1),
ranked AS (SELECT node, n, h, n - row_number() OVER (PARTITION BY node ORDER BY df DESC, h DESC) AS pos FROM t JOIN often USING (h)),
lead AS (SELECT * FROM ranked WHERE pos <= n - ceil(0.75 * n)),
pairs AS (SELECT DISTINCT a.node AS a, b.node AS b FROM lead a JOIN lead b ON a.h = b.h AND a.node < b.node AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
links AS (SELECT a, b FROM pairs JOIN cls x ON x.node = a JOIN cls y ON y.node = b WHERE 100 * len(list_intersect(x.key, y.key)) >= 75 * (x.n + y.n - len(list_intersect(x.key, y.key)))),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT node AS a, node AS b FROM cls UNION SELECT r.a, l.b FROM reach r JOIN sym l ON l.a = r.b),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, COALESCE(component, s.doc_id) AS component_id FROM s LEFT JOIN sets USING (doc_id) LEFT JOIN cls USING (key) LEFT JOIN comp ON comp.a = cls.node"""

_LEAK_WORDS = r"regexp_extract_all(translate(COALESCE({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_LEAK_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_LEAK_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, item_id, i, n FROM grams JOIN win USING (n, k)),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, CAST(COALESCE(len(l), 0) AS BIGINT) AS n_items, sha256(COALESCE(array_to_string(l, ','), '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUALITY = f"""WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, regexp_extract_all(COALESCE(text, ''), {_WORDS}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS r(i)),
often AS (SELECT doc_id, k FROM g GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g JOIN often USING (doc_id, k)) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS lines, COALESCE(n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""

ORACLES: dict[str, str] = {"op1_warc": WARC, "op2_preference": PREFERENCE, "op8_embeddings": EMBEDDINGS, "op10_jaccard": JACCARD, "op13_decontaminate": CONTAMINATION, "quality_counts": QUALITY}
