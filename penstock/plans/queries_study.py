"""Queries on scoring, similarity and quiz material, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import is_title_line
from ..functions.text import sentences as split_sentences
from ..operators import editing as E
from ..operators import issues as I
from ..operators import questions as Q
from ..operators import scoring as S
from . import fixtures as X
from .queries_model import ORACLES as MODEL_SQL
from .queries_model import protected_spans
from .queries_rules import fixture_sentences
from .queries_text import SENTENCES, docs

CANDIDATES = X.Fixture("fx_gates", "id long, fluency double, meaning double, style double, grammar double, drop double", [(1, 0.6, 0.95, 0.7, 0.0, 0.02), (2, 0.9, 0.75, 0.9, 0.0, 0.0), (3, 0.5, 0.9, 0.4, 1.0, 0.1), (4, 0.3, 0.85, 0.5, 0.0, 0.3), (5, 0.55, 0.99, 0.8, 0.0, 0.0)])
OPTIONS = X.Fixture("fx_options", "qid long, option string", [(q, o) for q in (1, 2) for o in ("pump", "valve", "hose", "meter")])
OFFERED = X.Fixture("fx_offered", "card_id long, front string", [(1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e")])
OWNED = X.Fixture("fx_owned", "card_id long, front string", [(1, "z"), (9, "y")])
HISTORY = X.Fixture("fx_history", "doc_id long, at long, level int, score double", [(1, 1, 1, 90.0), (1, 2, 2, 80.0), (2, 1, 1, 20.0), (3, 5, 4, 99.0), (3, 4, 1, 0.0), (4, 1, 3, 69.9)])
FACTS = X.Fixture("fx_facts", "id long, text string", [(1, "It ran 5 hours at 30 bar."), (2, "No number here."), (3, "Twice 7 and 7."), (4, "From 1990 to 2020, 3 tests.")])


def length_fits(spark, sf_dir):
    """Mean length fit of each document's sentences with the academic tone."""
    s = split_sentences(docs(spark, sf_dir))
    return s.groupBy("doc_id").agg(F.round(F.avg(S.length_fit(F.col("n_words"), "academic")), 4).alias("fit"))


def candidate_gates(spark, sf_dir):
    c = CANDIDATES.df(spark, sf_dir)
    total = S.candidate_total(F.col("fluency"), F.col("meaning"), F.col("style"), F.col("grammar"))
    return c.select("id", F.round(total, 4).alias("total"), S.reject_reason(F.col("meaning"), F.col("drop"), F.col("grammar")).alias("reason"))


def centroid_cosines(spark, sf_dir):
    """Cosine of every embedding with the mean of its label."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    # A row per label, and labels are few by the table's definition; left to adaptive execution all the same.
    return v.join(S.centroids(v, "label"), "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("centroid")), 3).alias("cosine"))


def turn_overlap(spark, sf_dir):
    """Word-multiset F1 of each conversation turn with the turn before."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return S.overlap_f1(t.join(before, ["conv_id", "turn"]), ["conv_id", "turn"], "text", "before").select("conv_id", "turn", F.round("f1", 4).alias("f1"))


def stacked_hedges(spark, sf_dir):
    return S.stacked_hedges(fixture_sentences(spark, sf_dir), sorted(I.LEXICONS["hedge"]))


def title_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return lines.where(is_title_line(F.col("line"))).select("doc_id", F.col("line_idx").cast("long"), F.md5(F.trim("line")).alias("digest"))


def cloze_gaps(spark, sf_dir):
    return Q.gaps(split_sentences(docs(spark, sf_dir))).select("doc_id", "sent_idx", "key", F.md5("prompt").alias("digest"))


def swapped_numbers(spark, sf_dir):
    return FACTS.df(spark, sf_dir).select("id", Q.swapped_numbers(F.col("text")).alias("text"))


def option_order(spark, sf_dir):
    return Q.options_in_order(OPTIONS.df(spark, sf_dir))


def glossary(spark, sf_dir):
    return Q.glossary(X.REPORT.df(spark, sf_dir))


def card_sync(spark, sf_dir):
    return Q.new_cards(OFFERED.df(spark, sf_dir), OWNED.df(spark, sf_dir))


def viva_next(spark, sf_dir):
    return Q.next_level(HISTORY.df(spark, sf_dir))


def greedy_spans(spark, sf_dir):
    """Non-overlapping protected spans of the corpus, from the left, the longest first."""
    return E.greedy_spans(protected_spans(spark, sf_dir))


def turn_edits(spark, sf_dir):
    """How many word-level hunks turn one conversation turn into the next."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.size(E.diff_hunks("before", "text")).cast("long").alias("hunks"))


QUERIES = {f.__name__: f for f in (length_fits, candidate_gates, centroid_cosines, turn_overlap, stacked_hedges, title_lines, cloze_gaps, swapped_numbers, option_order, glossary, card_sync, viva_next, greedy_spans, turn_edits)}

_HEDGES = "[" + ", ".join(f"'{h}'" for h in sorted(I.LEXICONS["hedge"])) + "]"
ORACLES = {
    "length_fits": f"WITH {SENTENCES} SELECT doc_id, round(avg(exp(-0.5::DOUBLE * ((len(words) - 21.0::DOUBLE) / 12.0::DOUBLE) * ((len(words) - 21.0::DOUBLE) / 12.0::DOUBLE))), 4) AS fit FROM sents GROUP BY doc_id",
    "candidate_gates": f"WITH {CANDIDATES.cte()} SELECT id, round(0.35::DOUBLE * fluency + 0.3::DOUBLE * meaning + 0.15::DOUBLE * style - 0.2::DOUBLE * grammar, 4) AS total, CASE WHEN meaning < 0.8 THEN 'meaning' WHEN \"drop\" > 0.15 THEN 'fluency' WHEN grammar > 0 THEN 'grammar' END AS reason FROM fx_gates",
    "centroid_cosines": """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2),
s AS (SELECT vec_id, sum(x * m) AS d, sqrt(sum(x * x)) * sqrt(sum(m * m)) AS z FROM e JOIN m USING (label, i) GROUP BY 1) SELECT vec_id, round(CASE WHEN z > 0 THEN d / z ELSE 0 END, 3) AS cosine FROM s""",
    "turn_overlap": """WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn + 1 = a.turn),
x AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(x) AS w FROM p) GROUP BY 1, 2, 3), y AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest(y) AS w FROM p) GROUP BY 1, 2, 3),
m AS (SELECT conv_id, turn, sum(least(x.n, y.n)) AS m FROM x JOIN y USING (conv_id, turn, w) GROUP BY 1, 2) SELECT p.conv_id, p.turn, round(CASE WHEN len(x) + len(y) > 0 THEN 2.0::DOUBLE * coalesce(m, 0) / (len(x) + len(y)) ELSE 0 END, 4) AS f1 FROM p LEFT JOIN m ON m.conv_id = p.conv_id AND m.turn = p.turn""",
    "stacked_hedges": f"""WITH {X.SENTENCES.cte()}, w AS (SELECT doc_id, sent_idx, unnest(v) AS w, generate_subscripts(v, 1) - 1 AS i FROM (SELECT *, regexp_extract_all(sentence, '[A-Za-z][A-Za-z''’-]*') AS v FROM fx_sentences)),
h AS (SELECT *, lag(i) OVER (PARTITION BY doc_id, sent_idx ORDER BY i) AS p FROM w WHERE list_contains({_HEDGES}, lower(w))) SELECT doc_id, sent_idx, i AS place FROM h WHERE i - p <= 6""",
    "title_lines": r"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents)
SELECT doc_id, line_idx, md5(t) AS digest FROM l WHERE t <> '' AND len(regexp_split_to_array(t, '\s+')) <= 14 AND NOT regexp_matches(t, '[.!?;:]$')""",
    "cloze_gaps": rf"""WITH {SENTENCES}, q AS (SELECT * FROM sents WHERE len(words) BETWEEN 6 AND 45 AND regexp_matches(sentence, '[.]\s*$')),
o AS (SELECT *, list_filter(words, lambda x: length(x) >= 7 AND len(list_filter(words, lambda y: lower(y) = lower(x))) = 1) AS o FROM q), k AS (SELECT *, list_filter(o, lambda x: length(x) = list_max(list_transform(o, lambda y: length(y))))[1] AS key FROM o)
SELECT doc_id, sent_idx, key, md5(substr(sentence, 1, instr(sentence, key) - 1) || '____' || substr(sentence, instr(sentence, key) + length(key))) AS digest FROM k WHERE key IS NOT NULL AND instr(sentence, key) > 0""",
    "swapped_numbers": f"WITH {FACTS.cte()}, m AS (SELECT id, text, regexp_extract(text, '^(.*?)([0-9]+)([^0-9]+)([0-9]+)(.*)$', ['a', 'b', 'c', 'd', 'e']) AS g, regexp_matches(text, '^(.*?)([0-9]+)([^0-9]+)([0-9]+)(.*)$') AS ok FROM fx_facts) SELECT id, CASE WHEN ok AND g.b <> g.d THEN g.a || g.d || g.c || g.b || g.e END AS text FROM m",
    "option_order": f"WITH {OPTIONS.cte()} SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY sha1(qid || ':' || option)) - 1 AS place, option FROM fx_options",
    "glossary": r"""WITH __REPORT__, f AS (SELECT doc_id, line_idx, unnest(regexp_extract_all(line, '[A-Za-z][A-Za-z -]* \([A-Z]{2,6}\)')) AS m FROM fx_report), t AS (SELECT doc_id, line_idx, regexp_extract(m, '\(([A-Z]+)\)', 1) AS term, string_split(regexp_extract(m, '^(.*) \(', 1), ' ') AS w FROM f),
e AS (SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda k: w[len(w) - k + 1:len(w)]), lambda v: upper(array_to_string(list_transform(v, lambda x: left(x, 1)), '')) = term)[1] AS v FROM t)
SELECT doc_id, term, arg_min(array_to_string(v, ' '), line_idx) AS expansion FROM e WHERE v IS NOT NULL GROUP BY 1, 2""".replace("__REPORT__", X.REPORT.cte()),
    "card_sync": f"WITH {OFFERED.cte()}, {OWNED.cte()} SELECT card_id, min(front) AS front FROM fx_offered ANTI JOIN fx_owned USING (card_id) GROUP BY 1",
    "viva_next": f"""WITH {HISTORY.cte()}, l AS (SELECT doc_id, arg_max(level, "at") AS level, arg_max(score, "at") AS score FROM fx_history GROUP BY 1) SELECT doc_id, least(greatest(level + CASE WHEN score >= 70 THEN 1 ELSE -1 END, 1), 4)::BIGINT AS level FROM l""",
}
ORACLES["greedy_spans"] = f"""WITH f AS ({MODEL_SQL['protected_spans']}),
g AS (SELECT doc_id, list({{'s': start, 'e': "end", 'ok': false}} ORDER BY start, "end" DESC) AS l FROM f WHERE start < "end" GROUP BY 1),
r AS (SELECT doc_id, list_reduce(list_prepend({{'at': 0::BIGINT, 'out': []::STRUCT(s BIGINT, e BIGINT)[]}}, list_transform(l, lambda x: {{'at': -1::BIGINT, 'out': [{{'s': x.s, 'e': x.e}}]}})),
  lambda a, x: CASE WHEN x.out[1].s >= a.at THEN {{'at': x.out[1].e, 'out': list_concat(a.out, x.out)}} ELSE a END) AS r FROM g)
SELECT doc_id, p.s AS start, p.e AS "end" FROM (SELECT doc_id, unnest(r.out) AS p FROM r)"""
