"""Queries on issues, report checks, spots, rewrites and graphs, with SQL for the same rows where SQL can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences as split_sentences
from ..functions.text import word_list
from ..operators import graph as G
from ..operators import issues as I
from ..operators import reports as P
from ..operators import rewriting as W
from . import fixtures as X
from .queries_text import SENTENCES, docs


def fixture_sentences(spark, sf_dir):
    return X.SENTENCES.df(spark, sf_dir).withColumn("words", word_list(F.col("sentence"))).withColumn("n_words", F.size("words").cast("long"))


def long_sentences(spark, sf_dir):
    return I.long_sentences(split_sentences(docs(spark, sf_dir)))


def repeated_openers(spark, sf_dir):
    return I.repeated_openers(split_sentences(docs(spark, sf_dir)))


def near_repeats(spark, sf_dir):
    return I.near_repeats(split_sentences(docs(spark, sf_dir)))


def lexicon_hits(spark, sf_dir):
    return I.lexicon_hits(fixture_sentences(spark, sf_dir))


#: Phrases that the invented corpus does contain.
JOINING = {"article": {"of the": None, "in the": None, "the": None}, "link": {"with": None, "that": None, "and": None}}


def lexicon_counts(spark, sf_dir):
    """Hits by phrase over the corpus's sentences, of phrases that it has."""
    return I.lexicon_hits(split_sentences(docs(spark, sf_dir)), JOINING).groupBy("lexicon", "phrase").agg(F.count("*").alias("n"))


def issues_deduplicated(spark, sf_dir):
    return I.keep_specific(X.ISSUES.df(spark, sf_dir))


def unsupported_claims(spark, sf_dir):
    return I.unsupported_claims(fixture_sentences(spark, sf_dir))


def plain_runs(spark, sf_dir):
    return I.plain_runs(fixture_sentences(spark, sf_dir))


def generic_spots(spark, sf_dir):
    """Vague sources, claims and fillers of the fixture within the caps."""
    rank = F.create_map(F.lit("vague_source"), F.lit(1), F.lit("claim"), F.lit(2), F.lit("filler"), F.lit(3))
    s = fixture_sentences(spark, sf_dir)
    spots = I.lexicon_hits(s).where(F.col("lexicon").isin("vague_source", "claim", "filler")).withColumn("priority", rank[F.col("lexicon")]).join(s.select("doc_id", "sent_idx", "section"), ["doc_id", "sent_idx"])
    return I.spots_within_caps(spots).select("doc_id", "sent_idx", "lexicon", "phrase")


def report_sections(spark, sf_dir):
    return P.sections(X.REPORT.df(spark, sf_dir))


def report_structure(spark, sf_dir):
    return P.structure_issues(X.REPORT.df(spark, sf_dir))


def report_abbreviations(spark, sf_dir):
    return P.abbreviations(X.REPORT.df(spark, sf_dir))


def report_figures(spark, sf_dir):
    return P.figures(X.REPORT.df(spark, sf_dir))


def report_units(spark, sf_dir):
    return P.units(X.REPORT.df(spark, sf_dir))


def rewrite_candidates(spark, sf_dir):
    return W.candidates(fixture_sentences(spark, sf_dir)).select("doc_id", "sent_idx", "transform", "text")


def rewrite_choice(spark, sf_dir):
    """Candidates scored by how short they are, chosen where shorter than the sentence."""
    c = W.candidates(fixture_sentences(spark, sf_dir)).withColumn("score", -F.length("text")).withColumn("base", -F.length("sentence"))
    return W.choose(c).select("doc_id", "sent_idx", "transform", "text")


def corpus_rewrites(spark, sf_dir):
    """Candidates over the whole corpus by transform."""
    c = W.candidates(split_sentences(docs(spark, sf_dir)))
    return c.groupBy("transform").agg(F.count("*").alias("n"), F.sum(F.length("text") - F.length("sentence")).alias("characters"))


def central_sentences(spark, sf_dir):
    """Most central sentence of the benchmark's texts."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text")
    r = G.central_sentences(split_sentences(b))
    return r.groupBy("doc_id").agg(F.max_by("sent_idx", F.struct(F.round("rank", 9), -F.col("sent_idx"))).alias("sent_idx"), F.count("*").alias("n"))


def word_cooccurrence(spark, sf_dir):
    """Sentences of a document that hold two of some frequent words."""
    concepts = spark.createDataFrame([(w,) for w in ("with", "that", "from", "have", "which", "this")], "c string")
    return G.cooccurrence(split_sentences(docs(spark, sf_dir)), concepts).where("n >= 2")


def similarity_degrees(spark, sf_dir):
    """Degree weights of the graph of word pairs over the corpus."""
    edges = word_cooccurrence(spark, sf_dir).groupBy("a", "b").agg(F.sum("n").alias("w"))
    return G.degree_weights(edges)


def _concepts(spark):
    return spark.createDataFrame([(w,) for w in ("with", "that", "from", "have", "which", "this")], "c string")


def word_meetings(spark, sf_dir):
    """word_cooccurrence with the pairs that meet in a single sentence of a document too."""
    return G.cooccurrence(split_sentences(docs(spark, sf_dir)), _concepts(spark))


def meeting_degrees(spark, sf_dir):
    """Degree weights of the graph of word pairs over the corpus, every meeting counted."""
    return G.degree_weights(word_meetings(spark, sf_dir).groupBy("a", "b").agg(F.sum("n").alias("w")))


def document_central_sentences(spark, sf_dir):
    """Most central sentence of every document with a word."""
    r = G.central_sentences_any_length(split_sentences(docs(spark, sf_dir)))
    return r.groupBy("doc_id").agg(F.max_by("sent_idx", F.struct(F.round("rank", 9), -F.col("sent_idx"))).alias("sent_idx"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    long_sentences, repeated_openers, near_repeats, lexicon_hits, lexicon_counts, issues_deduplicated, unsupported_claims, plain_runs, generic_spots, report_sections, report_structure, report_abbreviations,
    report_figures, report_units, rewrite_candidates, rewrite_choice, corpus_rewrites, central_sentences, word_cooccurrence, similarity_degrees,
    word_meetings, meeting_degrees, document_central_sentences,
)}

_FX = f"{X.SENTENCES.cte()}"


def _alt(phrases) -> str:
    # RE2 has no lookahead: the closing neighbour is dropped by doubling blanks beforehand.
    return "(?i)(?:^|[^A-Za-z])(" + "|".join(sorted(phrases, key=lambda p: (-len(p), p))) + ")(?:$|[^A-Za-z])"


def _hits(table: str, lexicons=I.LEXICONS) -> str:
    rows = ", ".join(f"('{n}', '{p}', {'NULL' if r is None else repr(r)})" for n, t in lexicons.items() for p, r in t.items())
    each = " UNION ALL ".join(f"SELECT doc_id, sent_idx, '{n}' AS lexicon, unnest(regexp_extract_all(regexp_replace(sentence, '([^A-Za-z])', '\\1\\1', 'g'), '{_alt(p).replace(' ', '  ')}', 1)) AS m FROM {table}" for n, p in lexicons.items())
    return f"lx(lexicon, phrase, plain) AS (VALUES {rows}), hm AS ({each}), hits AS (SELECT doc_id, sent_idx, hm.lexicon, lx.phrase, plain FROM hm JOIN lx ON lx.lexicon = hm.lexicon AND lx.phrase = replace(lower(m), '  ', ' '))"


_CLAIM = "(?i)(?:^|[^A-Za-z])(" + "|".join(sorted(I.LEXICONS["claim"], key=lambda p: (-len(p), p))) + ")(?:$|[^A-Za-z])"
_EVID = r"[0-9]|\([A-Z][a-z]+,? [0-9]{4}\)|\[[0-9]+\]|(?i)for example|e\.g\."


def _claims(table: str) -> str:
    return f"""cl AS (SELECT doc_id, sent_idx, regexp_matches(sentence, '{_CLAIM}') AS claim, regexp_matches(sentence, '{_EVID}') AS own FROM {table}),
nx AS (SELECT *, coalesce(lead(own) OVER (PARTITION BY doc_id ORDER BY sent_idx), false) AS nxt FROM cl) SELECT doc_id, sent_idx FROM nx WHERE claim AND NOT own AND NOT nxt"""


_SEC = "CASE regexp_replace(lower(trim(regexp_replace(regexp_replace(line, '^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s+', ''), '[:\\s]+$', ''))), 'x^', '') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.SECTIONS.items()) + " END"
_PRIO = "[" + ", ".join(repr(r) for r in I.PRIORITY) + "]"

ORACLES = {
    "long_sentences": f"WITH {SENTENCES} SELECT doc_id, sent_idx, len(words)::BIGINT AS n_words, CASE WHEN len(words) > 40 THEN 'warn' ELSE 'info' END AS severity FROM sents WHERE len(words) > 30",
    "repeated_openers": f"""WITH {SENTENCES}, o AS (SELECT doc_id, sent_idx, lower(words[1]) AS opener FROM sents),
l AS (SELECT *, coalesce((lag(opener) OVER w <> opener)::INTEGER, 1) AS new FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS run FROM l)
SELECT doc_id, min(sent_idx) AS first_sent, count(*) AS n, opener FROM r GROUP BY doc_id, run, opener HAVING count(*) >= 3""",
    "near_repeats": f"""WITH {SENTENCES}, w AS (SELECT DISTINCT doc_id, para_idx, sent_idx, word FROM (SELECT doc_id, para_idx, sent_idx, lower(unnest(words)) AS word FROM sents) WHERE length(word) >= 4),
l AS (SELECT *, lag(sent_idx) OVER (PARTITION BY doc_id, para_idx, word ORDER BY sent_idx) AS last FROM w) SELECT doc_id, sent_idx, word FROM l WHERE sent_idx - last <= 2""",
    "lexicon_hits": f"WITH {_FX}, {_hits('fx_sentences')} SELECT * FROM hits",
    "lexicon_counts": f"WITH {SENTENCES}, {_hits('sents', JOINING)} SELECT lexicon, phrase, count(*) AS n FROM hits GROUP BY 1, 2",
    "issues_deduplicated": f"""WITH {X.ISSUES.cte()}, r AS (SELECT *, coalesce(list_position({_PRIO}, rule), 0) AS rk FROM fx_issues),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY rk, rule) AS n FROM r WHERE rk > 0) WHERE n = 1)
SELECT doc_id, rule, start, "end" FROM r WHERE rk = 0 UNION ALL
SELECT doc_id, rule, start, "end" FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a."end" <= b."end" AND (a.start <> b.start OR a."end" <> b."end") AND b.rk <= a.rk)""",
    "unsupported_claims": f"WITH {_FX}, {_claims('fx_sentences')}",
    "plain_runs": f"""WITH {_FX}, c AS (SELECT *, regexp_matches(sentence, '[0-9]|[a-z,] [A-Z][a-z]+') AS c FROM fx_sentences),
n AS (SELECT *, (c OR coalesce(lag(c) OVER w OR lag(section) OVER w <> section, true))::INTEGER AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY sent_idx)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS run FROM n)
SELECT doc_id, min(sent_idx) AS first_sent, count(*) AS n FROM r WHERE NOT c GROUP BY doc_id, run HAVING count(*) >= 3""",
    "generic_spots": f"""WITH {_FX}, {_hits('fx_sentences')}, s AS (SELECT h.*, section, CASE lexicon WHEN 'vague_source' THEN 1 WHEN 'claim' THEN 2 ELSE 3 END AS p FROM hits h JOIN fx_sentences f USING (doc_id, sent_idx) WHERE lexicon IN ('vague_source', 'claim', 'filler')),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY p, sent_idx, phrase) AS n1 FROM s) WHERE n1 = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY p, sent_idx, phrase) AS n2 FROM a) WHERE n2 <= 2)
SELECT doc_id, sent_idx, lexicon, phrase FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p, sent_idx, phrase) AS n3 FROM b) WHERE n3 <= 25""",
    "report_sections": f"""WITH {X.REPORT.cte()}, h AS (SELECT doc_id, line_idx, {_SEC} AS name FROM fx_report), k AS (SELECT * FROM h WHERE name IS NOT NULL), e AS (SELECT doc_id, max(line_idx) AS last, min(line_idx) AS first FROM fx_report GROUP BY 1), f AS (SELECT doc_id, min(line_idx) AS h FROM k GROUP BY 1)
SELECT doc_id, name, line_idx AS first_line, coalesce(lead(line_idx) OVER (PARTITION BY doc_id ORDER BY line_idx) - 1, last) AS last_line FROM k JOIN e USING (doc_id)
UNION ALL SELECT e.doc_id, 'body', first, coalesce(h - 1, last) FROM e LEFT JOIN f ON f.doc_id = e.doc_id WHERE h IS NULL OR h > first""",
    "report_structure": f"""WITH {X.REPORT.cte()}, h AS (SELECT * FROM (SELECT doc_id, line_idx, {_SEC} AS section FROM fx_report) WHERE section IS NOT NULL), s AS (SELECT doc_id FROM h GROUP BY 1 HAVING count(DISTINCT section) >= 2),
n AS (SELECT doc_id, unnest({P.REQUIRED!r}) AS section FROM s), p AS (SELECT *, list_position({P.ORDER!r}, section) AS p FROM h), m AS (SELECT *, max(p) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM p)
SELECT doc_id, 'structure.missing' AS rule, section FROM n ANTI JOIN h USING (doc_id, section) UNION ALL SELECT doc_id, 'structure.order', section FROM m WHERE p < mx""",
    "report_abbreviations": rf"""WITH {X.REPORT.cte()}, d0 AS (SELECT doc_id, line_idx, unnest(regexp_extract_all(line, '[a-z]+ \(([A-Z]{{2,6}})\)', 1)) AS abbr FROM fx_report), u0 AS (SELECT doc_id, line_idx, unnest(regexp_extract_all(regexp_replace(line, '\([A-Z]{{2,6}}\)', '()', 'g'), '\b([A-Z]{{2,6}})\b', 1)) AS abbr FROM fx_report),
d AS (SELECT doc_id, abbr, min(line_idx) AS dl FROM d0 GROUP BY 1, 2), u AS (SELECT doc_id, abbr, min(line_idx) AS fu, max(line_idx) AS lu FROM u0 GROUP BY 1, 2), b AS (SELECT * FROM d FULL JOIN u USING (doc_id, abbr)),
m AS (SELECT doc_id, unnest(regexp_extract_all(line, '\(([A-Z]{{2,6}})\)', 1)) AS abbr FROM fx_report)
SELECT doc_id, 'abbr.undefined' AS rule, abbr FROM b WHERE fu IS NOT NULL AND (dl IS NULL OR fu < dl) UNION ALL SELECT doc_id, 'abbr.unused', abbr FROM b WHERE dl IS NOT NULL AND (lu IS NULL OR lu < dl) UNION ALL SELECT doc_id, 'abbr.redefined', abbr FROM m GROUP BY doc_id, abbr HAVING count(*) > 1""",
    "report_figures": rf"""WITH {X.REPORT.cte()}, c AS (SELECT doc_id, regexp_extract(line, '^(Figure|Table) ([0-9]+):', 1) AS kind, regexp_extract(line, '^(Figure|Table) ([0-9]+):', 2)::BIGINT AS number FROM fx_report WHERE regexp_matches(line, '^(Figure|Table) ([0-9]+):')),
m0 AS (SELECT doc_id, unnest(regexp_extract_all(line, '(?:Figure|Table) [0-9]+')) AS x FROM fx_report WHERE NOT regexp_matches(line, '^(Figure|Table) ([0-9]+):')), m AS (SELECT DISTINCT doc_id, split_part(x, ' ', 1) AS kind, split_part(x, ' ', 2)::BIGINT AS number FROM m0), g AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, kind ORDER BY number) AS p FROM c)
SELECT doc_id, 'figures.unreferenced' AS rule, kind, number FROM c ANTI JOIN m USING (doc_id, kind, number) UNION ALL SELECT doc_id, 'figures.missing', kind, number FROM m ANTI JOIN c USING (doc_id, kind, number) UNION ALL SELECT doc_id, 'figures.gap', kind, number FROM g WHERE number - p > 1""",
    "report_units": rf"""WITH {X.REPORT.cte()}, f0 AS (SELECT doc_id, unnest(regexp_extract_all(line, '[0-9]+(?:\.[0-9]+)?\s?(?:{'|'.join(sorted([*P.UNITS, *P.WRONG_UNITS], key=lambda x: (-len(x), x)))})\b')) AS surface FROM fx_report), f AS (SELECT *, regexp_extract(surface, '^[0-9.]+') AS number, regexp_extract(surface, '[A-Za-z]+$') AS unit FROM f0),
r AS (SELECT *, CASE unit {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in P.WRONG_UNITS.items())} END AS good, CASE unit {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in P.UNITS.items())} END AS q, CASE unit {' '.join(f"WHEN '{k}' THEN {v[1]}" for k, v in P.UNITS.items())} END AS si FROM f)
SELECT doc_id, 'units.symbol' AS rule, surface, number || ' ' || good AS suggestion FROM r WHERE good IS NOT NULL UNION ALL SELECT doc_id, 'units.spacing', surface, number || ' ' || unit FROM r WHERE good IS NULL AND NOT regexp_matches(surface, '\s') UNION ALL SELECT doc_id, 'units.mixed', q, NULL FROM r WHERE q IS NOT NULL GROUP BY doc_id, q HAVING count(DISTINCT si) = 2""",
    "word_cooccurrence": f"""WITH {SENTENCES}, w AS (SELECT DISTINCT doc_id, sent_idx, c FROM (SELECT doc_id, sent_idx, lower(unnest(words)) AS c FROM sents) WHERE c IN ('with', 'that', 'from', 'have', 'which', 'this'))
SELECT x.doc_id, x.c AS a, y.c AS b, count(*) AS n FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.sent_idx = y.sent_idx AND x.c < y.c GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
}
ORACLES["similarity_degrees"] = f"WITH e AS ({ORACLES['word_cooccurrence']}), s AS (SELECT a, b, sum(n) AS w FROM e GROUP BY 1, 2), u AS (SELECT a AS node, w FROM s UNION ALL SELECT b, w FROM s) SELECT node, sum(w)::BIGINT AS weight, count(*) AS degree FROM u GROUP BY 1"

ORACLES["word_meetings"] = f"""WITH {SENTENCES}, w AS (SELECT DISTINCT doc_id, sent_idx, c FROM (SELECT doc_id, sent_idx, lower(unnest(words)) AS c FROM sents) WHERE c IN ('with', 'that', 'from', 'have', 'which', 'this'))
SELECT x.doc_id, x.c AS a, y.c AS b, count(*) AS n FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.sent_idx = y.sent_idx AND x.c < y.c GROUP BY 1, 2, 3"""
ORACLES["meeting_degrees"] = f"WITH e AS ({ORACLES['word_meetings']}), s AS (SELECT a, b, sum(n) AS w FROM e GROUP BY 1, 2), u AS (SELECT a AS node, w FROM s UNION ALL SELECT b, w FROM s) SELECT node, sum(w)::BIGINT AS weight, count(*) AS degree FROM u GROUP BY 1"


def _swap(x: str, phrase: str, plain: str) -> str:
    return f"regexp_replace({x}, '(?i)(^|[^A-Za-z]){phrase.replace(chr(39), chr(39) * 2)}($|[^A-Za-z])', '\\1{plain}\\2', 'g')"


def _tidy(x: str) -> str:
    t = f"regexp_replace(trim(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), ' ([,.;:!?])', '\\1', 'g'), ' '), '^[,;:] ?', '')"
    return f"list_transform([{t}], lambda t: upper(left(t, 1)) || substr(t, 2))[1]"


def _simplified(x: str) -> str:
    pairs = [(p, r) for name in ("wordy_phrase", "filler") for p, r in I.LEXICONS[name].items() if r is not None]
    for phrase, plain in sorted(pairs, key=lambda v: (-len(v[0]), v[0])):
        x = _swap(x, phrase, plain)
    return _tidy(x)


def _dashes(x: str) -> str:
    return f"regexp_replace({x}, '([a-z]) [-–] ([^-–]+) [-–] ([a-z])', '\\1, \\2, \\3', 'g')"


def _expanded(x: str) -> str:
    for short, long_ in W.EXPANSIONS.items():
        x = _swap(x, short, long_)
    return _tidy(x)


def _candidates(table: str) -> str:
    made = {"phrase_simplify": _simplified("sentence"), "dash_tidy": _dashes("sentence"), "contractions": _expanded("sentence"), "all": _expanded(_dashes(_simplified("sentence")))}
    return "cand AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, sent_idx, sentence, '{n}' AS transform, {x} AS text FROM {table}" for n, x in made.items()) + ") WHERE text <> sentence)"


ORACLES |= {
    "rewrite_candidates": f"WITH {_FX}, {_candidates('fx_sentences')} SELECT doc_id, sent_idx, transform, text FROM cand",
    "rewrite_choice": f"WITH {_FX}, {_candidates('fx_sentences')} SELECT doc_id, sent_idx, transform, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY length(text), transform) AS n FROM cand WHERE length(text) < length(sentence)) WHERE n = 1",
    "corpus_rewrites": f"WITH {SENTENCES}, {_candidates('sents')} SELECT transform, count(*) AS n, sum(length(text) - length(sentence))::BIGINT AS characters FROM cand GROUP BY transform",
}
