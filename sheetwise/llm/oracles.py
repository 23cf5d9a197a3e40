"""DuckDB SQL for the text queries that SQL can express, written as plain scans over all windows and pairs."""

from __future__ import annotations

from .chat import OP2_SQL
from .quality_rules import RULES, mask
from .repair import OP11_SQL

WORD = "'[^\\x20\\x09-\\x0D]+'"

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top FROM p),
l AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v[CAST(k // 4 + 1 AS BIGINT)] >> (15 - 5 * (k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM l
"""

OP4 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, CAST(length(x) / 2 AS BIGINT) AS n FROM d),
t AS (SELECT doc_id, n, j, substr(x, 1000 * j + 1, 1098) AS x FROM (SELECT *, unnest(range(CAST(ceil(n / 500.0) AS BIGINT))) AS j FROM b)),
p AS (SELECT doc_id, n, 500 * j AS base, unnest(range(least(500, n - 500 * j))) AS o, x FROM t),
w AS (SELECT doc_id, n, base + o AS k, substr(x, 2 * o + 1, 2) AS byte, CASE WHEN base + o + 50 <= n THEN md5(substr(x, 2 * o + 1, 100)) END AS s FROM p),
low AS (SELECT s, min(doc_id) AS first FROM w WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) <> max(doc_id)),
f AS (SELECT w.doc_id, w.k, w.byte, coalesce(low.first < w.doc_id, false) AS hit FROM w LEFT JOIN low ON w.s = low.s),
c AS (SELECT doc_id, k, byte, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE gone AND NOT before) AS n_spans, string_agg(byte, '' ORDER BY k) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN r ON b.doc_id = r.doc_id
"""

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.root AS component_id FROM s JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""


def _op6() -> str:
    bits = " + ".join(f"CASE WHEN {p} THEN {1 << i} ELSE 0 END" for i, p in enumerate(RULES.values()))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, {WORD}) AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS k, ws FROM w WHERE len(ws) >= 8),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[k:k + 7], ' ')) > 1 AS twice FROM g),
c AS (SELECT count(DISTINCT k + j) AS n, doc_id FROM h, range(8) q(j) WHERE twice GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, CAST({bits} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, fail_bits & {mask("base")} <> 0 AS base_failed, fail_bits & {mask("v1")} = 0 AS kept, fail_bits FROM b
"""


OP9 = f"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), {WORD}) AS ws FROM benchmark WHERE text IS NOT NULL),
j AS (SELECT item_id, len(ws) AS n, list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) AS sh FROM i WHERE len(ws) >= 5),
js AS (SELECT item_id, n, x, count(*) AS c FROM (SELECT item_id, n, unnest(sh) AS x FROM j) GROUP BY item_id, n, x),
keys AS (SELECT DISTINCT n, x FROM js),
w AS (SELECT doc_id, regexp_extract_all(lower(text), {WORD}) AS ws FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, len(ws) AS size, list_transform(range(1, len(ws) - 3), lambda k: array_to_string(ws[k:k + 4], ' ')) AS sh FROM w WHERE len(ws) >= 5),
p AS (SELECT doc_id, size, unnest(sh) AS x, unnest(range(len(sh))) AS pos FROM d),
s AS (SELECT DISTINCT doc_id, n, greatest(0, least(pos, size - n)) AS start FROM p JOIN keys ON p.x = keys.x),
v AS (SELECT s.doc_id, s.n, s.start, unnest(d.sh[s.start + 1:s.start + s.n - 4]) AS x FROM s JOIN d ON s.doc_id = d.doc_id),
vc AS (SELECT doc_id, n, start, x, count(*) AS c FROM v GROUP BY doc_id, n, start, x),
vs AS (SELECT doc_id, n, start, sum(c) AS size FROM vc GROUP BY doc_id, n, start),
o AS (SELECT vc.doc_id, js.item_id, vc.n, vc.start, sum(least(vc.c, js.c)) AS c FROM vc JOIN js ON vc.n = js.n AND vc.x = js.x GROUP BY vc.doc_id, js.item_id, vc.n, vc.start),
q AS (SELECT o.doc_id, o.item_id, o.start, CAST(o.c AS DOUBLE) / (vs.size + o.n - 4 - o.c) AS sim, o.c, vs.size + o.n - 4 - o.c AS u FROM o JOIN vs ON o.doc_id = vs.doc_id AND o.n = vs.n AND o.start = vs.start)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) AS best FROM q WHERE 100 * c >= 80 * u) WHERE best = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op3_warc": OP3, "op4_suffix_dedup": OP4, "op5_ngram_jaccard": OP5, "op6_quality_rules": _op6(), "op9_decontaminate": OP9, "op11_repair": OP11_SQL}
