"""Queries on segmentation, rhythm, vocabulary, clarity, voice and scores, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..sources.tables import read_table


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet")


#: Sentences in DuckDB: lines, then breaks after [.!?] before a capital, quote or bracket.
SENTENCES = r"""
lines AS (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS line,
                 generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')), 1) - 1 AS para_idx FROM documents),
pieces AS (SELECT doc_id, para_idx, string_split(regexp_replace(line, '([.!?])\s+([A-Z"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM lines),
raw AS (SELECT doc_id, para_idx, unnest(p) AS s, generate_subscripts(p, 1) AS k FROM pieces),
sents AS (SELECT doc_id, para_idx, trim(s, ' ') AS sentence, regexp_extract_all(s, '[A-Za-z][A-Za-z''’-]*') AS words,
                 row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS sent_idx FROM raw WHERE regexp_matches(s, '[A-Za-z]'))"""
#: Words of whole texts in DuckDB.
WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*') AS w FROM documents)"""


def band_sql(x: str, points: list[tuple[float, float]]) -> str:
    out = f"CASE WHEN {x} <= {points[0][0]} THEN {float(points[0][1])!r}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out += f" WHEN {x} <= {x1} THEN {float(y0)!r}::DOUBLE + ({x} - {float(x0)!r}::DOUBLE) * {(y1 - y0) / (x1 - x0)!r}::DOUBLE"
    return out + f" ELSE {float(points[-1][1])!r}::DOUBLE END"


def sub_score_sql(name: str, drop: tuple[str, ...] = ()) -> str:
    own = {m: v for m, v in M.BANDS[name].items() if m not in drop}
    top = " + ".join(f"{w!r}::DOUBLE * ({band_sql(m, p)})" for m, (w, p) in own.items())
    return f"round(({top}) / {sum(w for w, _ in own.values())!r}::DOUBLE, 1)"


def word_limit(spark, sf_dir):
    """Documents over the word limit, with their counts."""
    w = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0B]+"), lambda x: x != "")).cast("long")
    return docs(spark, sf_dir).select("doc_id", w.alias("n_words")).where("n_words > 2000")


def normalised_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


def title_guess(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.title_guess(F.col("text")).alias("title"))


def paragraphs(spark, sf_dir):
    return T.paragraphs(docs(spark, sf_dir)).select("doc_id", "para_idx", "start", "end", F.md5("para_text").alias("digest"))


def sentences(spark, sf_dir):
    return T.sentences(docs(spark, sf_dir)).select("doc_id", "sent_idx", "para_idx", "n_words", F.md5("sentence").alias("digest"))


def lm_tokens(spark, sf_dir):
    t = T.lm_tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.filter("t", lambda x: x == "<num>")).cast("long").alias("n_numbers"), F.md5(F.concat_ws(" ", "t")).alias("digest"))


def heading_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return lines.where(T.heading_style(F.col("line")).isNotNull()).select("doc_id", F.col("line_idx").cast("long"), F.trim("line").alias("line"))


def running_lines(spark, sf_dir):
    """Lines, digits masked, that recur in three or more documents of a source."""
    lines = docs(spark, sf_dir).select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))
    key = F.trim(F.regexp_replace("line", "[0-9]+", "#"))
    rows = lines.select("doc_id", "source", key.alias("line")).where("line <> ''").distinct()
    return rows.groupBy("source", "line").agg(F.count("*").alias("n_docs")).where("n_docs >= 3").select("source", F.md5("line").alias("digest"), "n_docs")


def rhythm(spark, sf_dir):
    r = M.rhythm(docs(spark, sf_dir))
    return r.select("doc_id", "n_sents", *[F.round(c, 4).alias(c) for c in ("length_mean", "sentence_length_sd", "opener_entropy", "monotone_runs_per_10s")], "monotone_runs")


def rhythm_score(spark, sf_dir):
    """Flagship: rhythm sub-score of every document."""
    return M.rhythm(docs(spark, sf_dir)).select("doc_id", F.when(F.col("n_sents") > 0, M.sub_score("rhythm")).alias("rhythm"))


def mtld(spark, sf_dir):
    v = M.vocabulary(docs(spark, sf_dir))
    return v.select("doc_id", "n_words", "n_types", F.round("mtld", 4).alias("mtld"))


def clarity(spark, sf_dir):
    c = M.clarity(docs(spark, sf_dir))
    return c.select("doc_id", "n_words", "n_sents", *[F.round(x, 4).alias(x) for x in ("long_sentence_pct", "nominalizations_per_100w", "fk_grade_approx", "grade_excess")])


def voice(spark, sf_dir):
    return M.voice(docs(spark, sf_dir)).select("doc_id", F.round("passive_ratio", 4).alias("passive_ratio"))


def punctuation(spark, sf_dir):
    p = M.punctuation_rates(docs(spark, sf_dir))
    return p.select("doc_id", "n_sents", "n_words", *[F.round(c, 4).alias(c) for c in p.columns[3:]])


def scores(spark, sf_dir):
    return M.score_documents(read_table(spark, f"{sf_dir}/documents.parquet", even=True))


QUERIES = {
    "rhythm_score": rhythm_score, "word_limit": word_limit, "normalised_text": normalised_text, "title_guess": title_guess, "paragraphs": paragraphs, "sentences": sentences,
    "lm_tokens": lm_tokens, "heading_lines": heading_lines, "running_lines": running_lines, "rhythm": rhythm, "mtld": mtld, "clarity": clarity, "voice": voice, "punctuation_rates": punctuation,
    "document_scores": scores,
}

RUNS = """
grp AS (SELECT doc_id, list({'p': para_idx, 'n': len(words)} ORDER BY sent_idx) AS l FROM sents GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(list_prepend({'p': -1::BIGINT, 'lo': 0::BIGINT, 'hi': 0::BIGINT, 'k': 0::BIGINT, 'r': 0::BIGINT}, list_transform(l, lambda x: {'p': x.p::BIGINT, 'lo': x.n::BIGINT, 'hi': x.n::BIGINT, 'k': 1::BIGINT, 'r': 0::BIGINT})),
  lambda a, x: CASE WHEN a.p = x.p AND greatest(a.hi, x.hi) - least(a.lo, x.lo) <= greatest(2.0::DOUBLE, greatest(a.hi, x.hi)::DOUBLE * 0.15::DOUBLE)
    THEN {'p': x.p, 'lo': least(a.lo, x.lo), 'hi': greatest(a.hi, x.hi), 'k': a.k + 1, 'r': a.r}
    ELSE {'p': x.p, 'lo': x.lo, 'hi': x.hi, 'k': 1::BIGINT, 'r': a.r + CASE WHEN a.k >= 3 THEN 1 ELSE 0 END} END) AS f FROM grp),
runs AS (SELECT doc_id, f.r + CASE WHEN f.k >= 3 THEN 1 ELSE 0 END AS monotone_runs FROM folded)"""
_RHYTHM = f"""
{SENTENCES},{RUNS},
op AS (SELECT doc_id, lower(words[1]) AS o, count(*) AS c FROM sents GROUP BY 1, 2),
en AS (SELECT doc_id, sum(c) AS n, sum(CASE WHEN c > 1 THEN c * ln(c) ELSE 0.0::DOUBLE END) AS q FROM op GROUP BY 1),
st AS (SELECT doc_id, count(*) AS n_sents, avg(len(words)) AS length_mean, stddev_pop(len(words)) AS sd FROM sents GROUP BY 1),
rh AS (SELECT d.doc_id, coalesce(n_sents, 0) AS n_sents, coalesce(length_mean, 0.0::DOUBLE) AS length_mean,
  CASE WHEN coalesce(n_sents, 0) < 2 THEN 8.0::DOUBLE ELSE sd END AS sentence_length_sd,
  CASE WHEN coalesce(n_sents, 0) < 3 THEN 1.0::DOUBLE ELSE (ln(n) - q / n) / ln(n) END AS opener_entropy,
  coalesce(monotone_runs, 0) AS monotone_runs, CASE WHEN n_sents > 0 THEN monotone_runs * 10.0::DOUBLE / n_sents ELSE 0.0::DOUBLE END AS monotone_runs_per_10s
  FROM documents d LEFT JOIN st USING (doc_id) LEFT JOIN en USING (doc_id) LEFT JOIN runs USING (doc_id))"""
_CLARITY = f"""
{SENTENCES}, {WORDS},
st AS (SELECT doc_id, count(*) AS m, count(*) FILTER (len(words) > 30) AS k FROM sents GROUP BY 1),
cl AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(m, 0) AS n_sents,
  CASE WHEN m > 0 THEN 100.0::DOUBLE * k / m ELSE 0.0::DOUBLE END AS long_sentence_pct,
  100.0::DOUBLE * len(list_filter(w, lambda x: length(x) > 6 AND regexp_matches(lower(x), '(?:tion|sion|ment|ance|ence)s?$'))) / greatest(len(w), 1) AS nominalizations_per_100w,
  CASE WHEN m > 0 THEN 0.39::DOUBLE * len(w) / m + 11.8::DOUBLE * list_sum(list_transform(w, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')))))::DOUBLE / len(w) - 15.59::DOUBLE END AS fk_grade_approx
  FROM w LEFT JOIN st USING (doc_id)),
cx AS (SELECT *, CASE WHEN fk_grade_approx IS NOT NULL THEN greatest(0.0::DOUBLE, fk_grade_approx - 12) ELSE 0.0::DOUBLE END AS grade_excess FROM cl)"""
_VOICE = rf"""vo AS (SELECT d.doc_id, CASE WHEN count(s.sentence) > 0 THEN count(*) FILTER (regexp_matches(s.sentence, '(?i)(?:^|[^a-z])(?:is|are|was|were|be|been|being)\s+(?:[a-z]+ly\s+)?[a-z]+(?:ed|en|wn|lt|ught)(?:[^a-z]|$)'))::DOUBLE / count(s.sentence) ELSE 0.0::DOUBLE END AS passive_ratio
  FROM documents d LEFT JOIN sents s USING (doc_id) GROUP BY d.doc_id)"""

ORACLES = {
    "word_limit": r"SELECT doc_id, len(regexp_extract_all(text, '\S+'))::BIGINT AS n_words FROM documents WHERE len(regexp_extract_all(text, '\S+')) > 2000",
    "normalised_text": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents""",
    "title_guess": r"SELECT doc_id, left(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], ''), 70) AS title FROM documents",
    "paragraphs": r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
o AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(t) - 1 AS off FROM p),
q AS (SELECT *, regexp_replace(t, '^\s+', '') AS l FROM o WHERE regexp_matches(t, '\S')),
r AS (SELECT doc_id, k, (off + length(t) - length(l))::BIGINT AS start, regexp_replace(l, '\s+$', '') AS x FROM q)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS para_idx, start, start + length(x) AS "end", md5(x) AS digest FROM r""",
    "sentences": f"WITH {SENTENCES} SELECT doc_id, sent_idx, para_idx, len(words)::BIGINT AS n_words, md5(sentence) AS digest FROM sents",
    "lm_tokens": r"""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?|[0-9]+(?:[.,][0-9]+)*|[^\sa-z0-9]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '<num>' ELSE x END) AS t FROM documents)
SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_filter(t, lambda x: x = '<num>'))::BIGINT AS n_numbers, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "heading_lines": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents),
s AS (SELECT doc_id, line_idx, trim(line, ' ') AS line FROM l),
v AS (SELECT *, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') AS w FROM s WHERE line <> '' AND length(line) <= 90)
SELECT doc_id, line_idx, line FROM v WHERE line LIKE '#%' OR (len(w) <= 10 AND NOT regexp_matches(line, '[.?!,;]$') AND NOT (line LIKE '%:' AND len(w) > 6)
 AND (regexp_matches(line, '^(?:[0-9]+(?:\.[0-9]+)*|[IVX]+)[.)]?\s+[A-Z]') OR (upper(line) = line AND regexp_matches(line, '[A-Z]') AND len(w) <= 8)
      OR (len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= greatest(1.0, len(w) * 0.6) AND len(w) <= 6)))""",
    "running_lines": r"""
WITH l AS (SELECT DISTINCT doc_id, source, trim(regexp_replace(x, '[0-9]+', '#', 'g'), ' ') AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents))
SELECT source, md5(line) AS digest, count(*) AS n_docs FROM l WHERE line <> '' GROUP BY source, line HAVING count(*) >= 3""",
    "rhythm": f"WITH {_RHYTHM} SELECT doc_id, n_sents, round(length_mean, 4) AS length_mean, round(sentence_length_sd, 4) AS sentence_length_sd, round(opener_entropy, 4) AS opener_entropy, round(monotone_runs_per_10s, 4) AS monotone_runs_per_10s, monotone_runs FROM rh",
    "rhythm_score": f"WITH {_RHYTHM} SELECT doc_id, CASE WHEN n_sents > 0 THEN {sub_score_sql('rhythm')} END AS rhythm FROM rh",
    "clarity": f"WITH {_CLARITY} SELECT doc_id, n_words, n_sents, round(long_sentence_pct, 4) AS long_sentence_pct, round(nominalizations_per_100w, 4) AS nominalizations_per_100w, round(fk_grade_approx, 4) AS fk_grade_approx, round(grade_excess, 4) AS grade_excess FROM cx",
    "voice": f"WITH {SENTENCES}, {_VOICE} SELECT doc_id, round(passive_ratio, 4) AS passive_ratio FROM vo",
    "punctuation_rates": rf"""
WITH {SENTENCES}, {WORDS}, st AS (SELECT doc_id, count(*) AS m FROM sents GROUP BY 1),
b AS (SELECT d.doc_id, d.text AS t, coalesce(m, 0) AS n_sents, len(w)::BIGINT AS n_words, w FROM documents d JOIN w USING (doc_id) LEFT JOIN st USING (doc_id))
SELECT doc_id, n_sents, n_words, {", ".join(f"round(CASE WHEN n_sents > 0 THEN len(regexp_extract_all(t, '{p}'))::DOUBLE / n_sents ELSE 0 END, 4) AS {c}_per_sentence" for c, p in (("commas", ","), ("semicolons", ";"), ("parentheses", chr(92) + "("), ("questions", chr(92) + "?"), ("contractions", "(?i)" + chr(92) + "b" + chr(92) + "w+(?:n''t|''re|''ve|''ll|''d|''m|''s)" + chr(92) + "b")))},
  round(CASE WHEN n_words > 0 THEN list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / n_words ELSE 0 END, 4) AS word_length_mean,
  round(1000.0::DOUBLE * len(list_filter(w, lambda x: lower(x) IN ('i', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours', 'myself', 'ourselves'))) / greatest(n_words, 1), 4) AS first_person_per_1000 FROM b""",
}
