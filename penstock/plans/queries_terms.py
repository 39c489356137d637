"""Queries on keyphrases, card ids, phrases in all their forms, sections at offsets and gists, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import fnv1a36
from ..operators import keyphrases as K
from ..functions.text import find_spans
from ..operators import detectors as D
from ..operators import gist as G
from ..operators import phrasebook as B
from ..operators import sections as S
from .queries_more import MASKED, _SECT, issues_sql, spans_sql
from .queries_text import docs
from .seeded import FORM_SEEDS, REPORT_SEEDS, seeded, seeded_sql


def keyphrases(spark, sf_dir):
    """The ten best phrases of every document."""
    return K.keyphrases(docs(spark, sf_dir), pool=None).select("doc_id", "place", "phrase", "n", F.round("score", 6).alias("score"), "start", "end")


def protected_terms(spark, sf_dir):
    return K.terms(docs(spark, sf_dir)).select("doc_id", "kind", "start", "end", "surface")


def card_ids(spark, sf_dir):
    """Ids of the cards that the turns of the conversations would make."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", fnv1a36(F.concat_ws(":", "role", "text")).alias("card_id"))


def inflected_phrases(spark, sf_dir):
    """Phrases in all their forms, with the plainer wording, over documents that hold such phrases."""
    return B.find_phrases(seeded(spark, sf_dir, FORM_SEEDS)).drop("_row")


def phrase_savings(spark, sf_dir):
    return B.phrase_savings(B.find_phrases(seeded(spark, sf_dir, FORM_SEEDS)))


def body_issues(spark, sf_dir):
    """Issues of documents with sections, without those in headings and references."""
    return D.analyse(seeded(spark, sf_dir, REPORT_SEEDS), body=True).select("doc_id", "issue_id", "rule", "severity", "start", "end")


def issues_by_section(spark, sf_dir):
    """How many passives and fillers each section of a document has, references included."""
    docs = seeded(spark, sf_dir, REPORT_SEEDS)
    found = find_spans(docs, {r: D.RULES[r][0] for r in ("passive", "filler")} | {"heading": S.HEADING_LINE})
    heads = found.where("kind = 'heading'").select("doc_id", "start", S.heading_name(F.col("surface")).alias("name"))
    rows = S.section_at(found.where("kind <> 'heading'"), heads)
    return rows.groupBy("doc_id", "section", F.col("kind").alias("rule")).agg(F.count("*").alias("n"))


def document_gists(spark, sf_dir):
    """The gist of every document; PageRank, so no SQL: tests hold it against a plain version."""
    return G.gists(seeded(spark, sf_dir)).select("doc_id", "sent_idx", "gist")


QUERIES = {f.__name__: f for f in (keyphrases, protected_terms, card_ids, inflected_phrases, phrase_savings, body_issues, issues_by_section, document_gists)}

_STOP = ", ".join(f"'{w}'" for w in K.STOP)
#: Tokens with offsets and sentences, as placed_tokens() has them.
_TOKENS = r"""
f AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}][\p{L}''’-]*|[^ \t\r\n\p{L}]+') AS t, string_split_regex(text, '[\p{L}][\p{L}''’-]*|[^ \t\r\n\p{L}]+') AS g FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(t) AS token, unnest(g[1:len(t)]) AS gap, generate_subscripts(t, 1) - 1 AS pos FROM f),
b AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM e),
h AS (SELECT *, CASE WHEN before IS NULL OR contains(gap, chr(10)) OR (regexp_matches(before, '[.!?]$') AND gap <> '' AND regexp_matches(token, '^[A-Z"“(]')) THEN 1 ELSE 0 END AS fresh FROM b),
tok AS (SELECT doc_id, pos, token, fresh, sum(length(gap) + length(token)) OVER o AS e, sum(fresh) OVER o - 1 AS sent, CASE WHEN regexp_matches(token, '^\p{L}') THEN lower(token) END AS word FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""
_KEYPHRASES = rf"""{_TOKENS},
near AS (SELECT *, CASE WHEN lag(sent) OVER o = sent THEN lag(word) OVER o END AS l, CASE WHEN lead(sent) OVER o = sent THEN lead(word) OVER o END AS r FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
w AS (SELECT *, length(word) < 3 OR word IN ({_STOP}) AS stop, regexp_replace(token, '[^\p{{L}}]', '', 'g') AS letters FROM near WHERE word IS NOT NULL),
st AS (SELECT doc_id, word, any_value(stop) AS stop, count(*) AS tf, count(DISTINCT sent) AS sf, coalesce(count(DISTINCT l) / nullif(count(l), 0), 0) + coalesce(count(DISTINCT r) / nullif(count(r), 0), 0) AS context,
              greatest(count(*) FILTER (left(token, 1) <> left(word, 1) AND fresh = 0), count(*) FILTER (length(letters) > 1 AND letters = upper(letters))) AS cap FROM w GROUP BY 1, 2),
md AS (SELECT doc_id, word, median(sent) AS m FROM (SELECT DISTINCT doc_id, word, sent FROM w) GROUP BY 1, 2),
n AS (SELECT doc_id, max(sent) + 1 AS n_sent FROM w GROUP BY 1),
al AS (SELECT doc_id, coalesce(avg(tf) FILTER (NOT stop) + stddev_pop(tf) FILTER (NOT stop), 1) AS usual, max(tf) AS top FROM st GROUP BY 1),
wt AS (SELECT doc_id, word, stop, rel * ln(ln(3 + m)) / (cap / (1 + ln(tf)) + tf / usual / rel + sf / n_sent / rel) AS weight FROM (SELECT *, 1 + context * tf / top AS rel FROM st JOIN md USING (doc_id, word) JOIN n USING (doc_id) JOIN al USING (doc_id))),
s1 AS (SELECT w.doc_id, w.pos, w.sent, w.word AS phrase, weight, e, e - length(token) AS s FROM w JOIN wt ON w.doc_id = wt.doc_id AND w.word = wt.word WHERE NOT w.stop),
cand AS (SELECT doc_id, phrase, s, e, weight AS p, weight AS q FROM s1
  UNION ALL SELECT a.doc_id, a.phrase || ' ' || b.phrase, a.s, b.e, a.weight * b.weight, a.weight + b.weight FROM s1 a JOIN s1 b ON a.doc_id = b.doc_id AND a.sent = b.sent AND b.pos = a.pos + 1
  UNION ALL SELECT a.doc_id, a.phrase || ' ' || b.phrase || ' ' || c.phrase, a.s, c.e, a.weight * b.weight * c.weight, a.weight + b.weight + c.weight FROM s1 a JOIN s1 b ON a.doc_id = b.doc_id AND a.sent = b.sent AND b.pos = a.pos + 1 JOIN s1 c ON a.doc_id = c.doc_id AND a.sent = c.sent AND c.pos = a.pos + 2),
sc AS (SELECT doc_id, phrase, count(*) AS n, max(p) / (count(*) * (1 + max(q))) AS score, min(s) AS start, arg_min(e, s) AS "end" FROM cand GROUP BY 1, 2),
pool AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 10), phrase) AS k FROM sc),
kept AS (SELECT doc_id, list_reduce(list(phrase ORDER BY k), lambda acc, x: CASE WHEN len(acc) >= 10 OR len(list_filter(acc, lambda y: contains(x, y) OR contains(y, x) OR 1 - levenshtein(x, y) / greatest(length(x), length(y)) > 0.8)) > 0 THEN acc ELSE list_append(acc, x) END, []::VARCHAR[]) AS ps FROM pool GROUP BY 1),
kp AS (SELECT doc_id, place, phrase, n, score, start, "end" FROM (SELECT doc_id, unnest(ps) AS phrase, generate_subscripts(ps, 1) - 1 AS place FROM kept) JOIN pool USING (doc_id, phrase))"""


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _matches() -> str:
    """Pieces of the texts, runs of them that are phrases, the longest of each start, and of those the ones that a walk from the left takes."""
    table = ", ".join("(" + ", ".join(map(_quoted, p)) + ")" for p in B.build_phrases())
    sizes = sorted({sum(1 for _ in B.pieces(p.surface)) for p in B.build_phrases()})
    return rf"""{seeded_sql(seeds=FORM_SEEDS)}, book(phrase, surface, form, wording) AS (VALUES {table}),
raw AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_-]+|[''’]|\s+|[^\p{{L}}\p{{N}}_\s''’-]') AS r FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, unnest(r) AS x, generate_subscripts(r, 1) AS p FROM raw),
piece AS (SELECT *, CASE WHEN trim(x, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN ' ' WHEN x = '’' THEN chr(39) ELSE lower(x) END AS t, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY p) - length(x) AS start FROM cut),
ahead AS (SELECT doc_id, p, start, t, list(t) OVER o AS ts, list(x) OVER o AS xs FROM piece WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {max(sizes) - 1} FOLLOWING)),
firsts AS (SELECT DISTINCT regexp_extract(surface, '^[a-z-]+') AS t FROM book),
runs AS (SELECT doc_id, p, start, k, array_to_string(ts[1:k], '') AS surface, array_to_string(xs[1:k], '') AS found FROM ahead SEMI JOIN firsts USING (t), unnest({sizes}) AS u(k) WHERE k <= len(ts)),
longest AS (SELECT doc_id, p::BIGINT AS p, max(k)::BIGINT AS k, arg_max(surface, k) AS surface, arg_max(found, k) AS found, any_value(start)::BIGINT AS start FROM runs SEMI JOIN book USING (surface) GROUP BY 1, 2),
walk AS (SELECT doc_id, unnest(list_reduce(list({{'p': p, 'e': p + k}} ORDER BY p), lambda a, x: CASE WHEN len(a) > 0 AND x.p < a[-1].e THEN a ELSE list_append(a, x) END, []::STRUCT(p BIGINT, e BIGINT)[])).p AS p FROM longest GROUP BY 1),
placed AS (SELECT * FROM longest SEMI JOIN walk USING (doc_id, p)),
said AS (SELECT doc_id, start, (start + length(found))::BIGINT AS "end", phrase, form, found AS surface,
  CASE WHEN wording = '' THEN '' WHEN found = upper(found) AND length(regexp_replace(found, '[^\p{{L}}]', '', 'g')) > 1 THEN upper(wording) WHEN left(found, 1) <> lower(left(found, 1)) THEN upper(left(wording, 1)) || substr(wording, 2) ELSE wording END AS wording
  FROM placed JOIN book USING (surface))"""


def _sectioned(spans: str) -> str:
    """Spans of the documents with headings, each with the section it starts in and whether it lies in a heading."""
    return rf"""{seeded_sql(seeds=REPORT_SEEDS)}, {spans},
pl0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
heads AS (SELECT doc_id, hend - length(line) - (k > 1)::INT AS hstart, hend, sec FROM (SELECT *, {_SECT} AS sec, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1)::BIGINT AS hend FROM pl0) WHERE sec IS NOT NULL),
secd AS (SELECT i.*, coalesce(h.sec, 'body') AS section, NOT EXISTS (SELECT 1 FROM heads x WHERE x.doc_id = i.doc_id AND x.hstart < i."end" AND i.start < x.hend) AS free FROM iss i ASOF LEFT JOIN heads h ON i.doc_id = h.doc_id AND i.start >= h.hstart)"""


ORACLES = {
    "keyphrases": f'WITH {_KEYPHRASES} SELECT doc_id, place, phrase, n, round(score, 6) AS score, start, "end" FROM kp',
    "protected_terms": f"""WITH {_KEYPHRASES} SELECT doc_id, 'term' AS kind, start, "end", phrase AS surface FROM kp WHERE n >= 2 OR contains(phrase, ' ')""",
    "card_ids": """WITH c AS (SELECT conv_id, turn, concat_ws(':', role, text) AS x FROM conversations)
SELECT conv_id, turn, lower(to_base(list_reduce(list_transform(list_filter(string_split(x, ''), lambda s: s <> ''), lambda s: unicode(s)::BIGINT), lambda a, u: ((xor(a, u)::HUGEINT * 16777619) % 4294967296)::BIGINT, 2166136261::BIGINT), 36)) AS card_id FROM c""",
    "inflected_phrases": f"WITH {_matches()} SELECT * FROM said",
    "phrase_savings": f"""WITH {_matches()} SELECT doc_id, phrase, count(*) AS n, count(DISTINCT form) AS n_forms, sum(CASE WHEN wording IS NULL THEN 0 ELSE "end" - start - length(wording) END)::BIGINT AS saved FROM said GROUP BY 1, 2""",
    "body_issues": f"""WITH {_sectioned(issues_sql(MASKED))} SELECT doc_id, issue_id, rule, severity, start, "end" FROM secd WHERE free AND section <> 'references'""",
    "issues_by_section": f"""WITH {_sectioned(spans_sql('iss', MASKED, {r: D.RULES[r][0] for r in ('passive', 'filler')}))} SELECT doc_id, section, kind AS rule, count(*) AS n FROM secd GROUP BY 1, 2, 3""",
}
