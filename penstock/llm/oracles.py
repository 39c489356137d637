"""DuckDB SQL for the rows of queries whose method does not show in the result."""

from __future__ import annotations

from .quality_rules import BASE, RULES

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"


def _quality() -> str:
    rates, strengths = [], []
    for r in RULES:
        m = f"(k_{r} / n)"
        v = f"(q_{r} / n - {m} * {m} - {m} * (1 - {m}) * h / n)"
        strengths.append(f"{m} AS m_{r}, CASE WHEN {v} > 0 THEN least(greatest({m} * (1 - {m}) / {v} - 1, 10.0::DOUBLE), 1e6::DOUBLE) ELSE 1e6::DOUBLE END AS s_{r}")
        rates.append(f"(hk.k_{r} + m_{r} * s_{r}) / (n_docs + s_{r}) >= 0.5")
    flags = ", ".join(f"({rule}) AS f_{name}" for name, rule in RULES.items())
    return rf"""
WITH b AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {SPACED})) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM k WHERE c > 1) GROUP BY 1),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN rp USING (doc_id)),
f AS (SELECT *, {flags} FROM m),
hk AS (SELECT source, count(*)::DOUBLE AS n_docs, {", ".join(f"sum(f_{r}::INTEGER)::DOUBLE AS k_{r}" for r in RULES)} FROM f WHERE source IS NOT NULL GROUP BY 1),
pr AS (SELECT sum(n_docs) AS n, count(*) AS h, {", ".join(f"sum(k_{r}) AS k_{r}, sum(k_{r} * k_{r} / n_docs) AS q_{r}" for r in RULES)} FROM hk), st AS (SELECT {", ".join(strengths)} FROM pr),
hv AS (SELECT source, {" OR ".join(rates)} AS rejected FROM hk CROSS JOIN st)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({" OR ".join(f"f_{r}" for r in BASE)}) AS base_failed,
  NOT ({" OR ".join(f"f_{r}" for r in BASE)}) AND NOT (coalesce(rejected, false) AND ({" OR ".join(f"f_{r}" for r in RULES)})) AS kept, coalesce(rejected, false) AS host_rejected FROM f LEFT JOIN hv USING (source)"""


ORACLES = {
    "op1_quality_rules": _quality(),
    "op3_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, {SPACED}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), s AS (SELECT g FROM g GROUP BY 1 HAVING count(*) > 1), h AS (SELECT g.* FROM g SEMI JOIN s USING (g)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op4_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
k AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM b WHERE length(x) >= 800)),
d AS (SELECT h FROM k GROUP BY 1 HAVING count(*) > 1), s AS (SELECT doc_id, i FROM k SEMI JOIN d USING (h)),
o AS (SELECT *, (coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true))::INTEGER AS new FROM s), q AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
c AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS z FROM q GROUP BY 1, 2), v AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM c),
t AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone, max(z) AS last, string_agg(substr(x, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM v JOIN b USING (doc_id) GROUP BY 1)
SELECT b.doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256 FROM b LEFT JOIN t ON t.doc_id = b.doc_id""",
    "op8_warc": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM g""",
    "op10_decontamination": f"""
WITH iw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark), dw AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
wi AS (SELECT item, w, least(10, len(w)) AS z FROM iw WHERE len(w) > 0), wk AS (SELECT DISTINCT item, z, array_to_string(w[i:i+z-1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM wi)), zz AS (SELECT DISTINCT z FROM wk),
dk AS (SELECT doc_id, z, i, array_to_string(w[i:i+z-1], ' ') AS k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM dw JOIN zz ON len(w) >= z)),
h AS (SELECT doc_id, dk.z, i, item FROM dk JOIN wk ON wk.z = dk.z AND wk.k = dk.k), c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated FROM dw LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS x, ('0x' || s[9:16])::BIGINT % (n + 1) AS y, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c""",
    "op13_prefix_trie": """
WITH tb AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
z AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i, d, chars FROM z),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t) CROSS JOIN tb),
r AS (SELECT c.conv_id, 0 AS part, i, d, chars FROM c JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT t.conv_id, 1, i, d, chars FROM t JOIN c USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS k, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, i ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT k, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM p GROUP BY 1),
ch AS (SELECT k[1:length(k) - 32] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(k, depth) AS k FROM p GROUP BY 1) GROUP BY 1),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (k)),
s AS (SELECT p.k, sum((n_convs - 1) * u.chars) AS saved, sum((n_children = 0)::INTEGER) AS leaves FROM u JOIN p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY 1)
SELECT u.conv_id, u.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, u.n_convs::BIGINT AS n_convs, u.n_children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM u JOIN s ON s.k = u.k LEFT JOIN n q ON u.depth > 0 AND q.k = u.k[1:length(u.k) - 32] LEFT JOIN e ON e.k = u.k""",
}
