"""Queries on detectors, the issues relation, the order of sentences, fits and a learner's side, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators import client as CL
from ..operators import detectors as D
from ..operators import fingerprint as FP
from ..operators import fit as FT
from ..operators import flow as FL
from ..operators import services as SV
from ..operators import spans as S
from ..operators.editing import minimal_edit
from ..operators.fingerprint import fingerprints as fingerprints_of
from ..operators.issues import LEXICONS, PRIORITY
from . import fixtures as X
from .queries_model import _islands_sql
from .queries_rules import ORACLES as RULES
from .queries_text import SENTENCES, WORDS, docs

KEEP = ["orifice plate", "Reynolds number"]
TEXTS = X.Fixture("fx_texts", "doc_id long, text string", [
    (1, "Run `make all` first, then stop(now); the rest is easy."), (2, "Here F = m*a holds and $E=mc^2$ too, but a and b do not."), (3, 'They said "very good" and left.'), (4, "Shown before [3, 5-7] and (Smith et al., 2019) and by Jones (2004)."),
    (5, "See Fig. 3 and Tables 2 to 4, or Section 1.2."), (6, "Mail me@site.org or see https://a.b/c?d=1 and www.x.org now."), (7, "It took 12.5 kPa, -3 mm, 40 % and 1e-3 of 7 apples."), (8, "The HVAC and the PhD used FEMs; the Pump did not."),
    (9, "An Orifice Plate has a reynolds number."), (10, "No spans here."), (11, None), (12, ""),
    (13, "In order to help, it is important to note that the results were made by hand. \"In order to\" is quoted."), (14, "There are some parts that are worn — and due to the fact that it was very old, it failed."),
    (15, "This is not just a toy, but a tool. We carried out an analysis of it; at the end of the day it may seem fine."), (16, "Basically a cutting-edge idea (see `very good`) perhaps."),
])
FLOW = X.Fixture("fx_flow", "doc_id long, sent_idx long, para_idx long, n_words long, sentence string", [
    (1, 0, 0, 4, "However, the pump ran."), (1, 1, 0, 6, "It was tested by the team."), (1, 2, 0, 4, "However, it then failed."), (1, 3, 0, 5, "Moreover, in addition, the valve moved."), (1, 4, 1, 3, "It stopped again."), (1, 5, 1, 3, "It ran on."), (1, 6, 1, 3, "It was cold."), (1, 7, 1, 4, "It was very wet."),
    (1, 8, 2, 13, "Moreover, it is important to note that the valve of the pump leaked badly."), (2, 0, 0, 3, "Was it cold?"), (2, 1, 0, 4, "Note that it was."), (2, 2, 0, 9, "For example, therefore, the hose and pump were both old."),
])
LINES = X.Fixture("fx_lines", "doc_id long, line_idx long, line string", [
    (1, 0, "A title"), (1, 1, "Abstract"), (1, 2, "one two three four five six"), (1, 3, "seven eight nine"), (1, 4, "2. Results"), (1, 5, "The mass was 12 and the flow was fine."), (1, 6, "The pressure was 12 kPa."), (1, 7, "The length is 5."), (1, 8, "The pump was tested."), (1, 9, "References"), (1, 10, "The mass was 9."),
    (2, 0, "Summary"), (2, 1, "short"), (2, 2, "Discussion"), (2, 3, "The temperature is 30 °C."), (2, 4, "It shows the force of 30, then stops."), (2, 5, "It was odd."),
])
MENTIONS = X.Fixture("fx_mentions", "doc_id long, kind string, number long, start long", [(1, "figure", 1, 5), (1, "figure", 3, 20), (1, "figure", 2, 30), (1, "figure", 3, 50), (1, "table", 2, 8), (1, "table", 1, 40), (2, "figure", 4, 1), (2, "figure", 5, 9), (2, "figure", 1, 20)])
CHANGES = X.Fixture("fx_changes", "doc_id long, change_id long, start long, end long, original string, replacement string, decision string, confidence double", [
    (1, 1, 0, 3, "the", "a", "accepted", 0.9), (1, 2, 10, 15, "brown", "red", None, 0.85), (1, 3, 16, 19, "fox", "cat", "rejected", 0.9), (1, 4, 20, 25, "jumps", "leaps", None, 0.7), (1, 5, 40, 45, "ghost", "x", None, 0.95), (1, 6, 42, 44, "os", "y", None, 0.95), (2, 1, 3, 3, "", "new ", None, 0.99), (2, 2, 4, 7, "two", "2", None, 0.99),
])
EDITED = X.Fixture("fx_edited", "doc_id long, text string", [(1, "a quick brown fox really jumps"), (2, "one TWO three")])
FITS = X.Fixture("fx_fits", "id long, text string, tone string, want double, commas double, hits long, length double, repeats long, original double, candidate double, meaning double", [
    (1, "So, we don't know that it's the best.", "academic", None, None, 0, 0.8, 0, -2.0, -1.5, 0.95), (2, "So, we don't know that it's the best.", "casual", None, 1.0, 1, 0.5, 1, -2.0, -2.6, 0.8), (3, "The pump of the unit is old.", "neutral", None, 2.0, 2, 1.0, None, -3.0, -2.0, 0.99), (4, "But they're late, you'll see.", "neutral", 1.0, None, 0, 0.1, 2, -1.0, -3.5, 0.7), (5, "", "academic", 0.5, None, 3, 0.0, None, -1.0, -1.0, 1.0),
])
RATES = {"the": 60.0, "of": 30.0, "that": 9.0, "it": 7.9, "we": 0.5, "know": 0.2}
EDIT_SET = X.Fixture("fx_edit_set", "doc_id long, sent_idx long, edit_id long, start long, end long", [(1, 0, 1, 0, 5), (1, 0, 2, 5, 8), (1, 0, 3, 7, 9), (1, 0, 4, 12, 14), (1, 1, 5, 0, 2), (1, 1, 6, 3, 4), (2, 0, 7, 1, 2)])
CANDIDATES = X.Fixture("fx_candidates", "doc_id long, sent_idx long, cand_idx long, text string, n_edits long, rejected string", [(1, 0, k, t, n, r) for k, (t, n, r) in enumerate([("a", 1, None), ("b", 1, "meaning"), ("c", 2, None), ("a", 2, None), ("d", 1, "fluency"), ("e", 1, None), ("f", 3, "meaning"), ("g", 1, None), ("h", 1, None), ("i", 1, "grammar")])] + [(2, 0, 0, "z", 1, None)])
QUIZ = X.Fixture("fx_quiz", "doc_id long, qid long, prompt string, key string, score double", [(1, 1, "Pump?", "water", None), (1, 2, "Valve?", "stop", None), (1, 3, "Why?", None, 60.0), (2, 1, "How?", None, 40.0), (2, 2, "When?", None, None), (3, 1, "Who?", "team", None)])
GIVEN = X.Fixture("fx_given", "doc_id long, qid long, answer string", [(1, 1, " Water"), (1, 3, "because"), (2, 1, "so"), (3, 1, "nobody"), (9, 9, "stray")])
TERMS = X.Fixture("fx_terms", "doc_id long, term string, definition string", [(1, "Pump", "moves water"), (1, "pump", "a device"), (2, "Valve", ""), (2, "Hose", None), (3, "Team", "people")])
OLD_PARAS = X.Fixture("fx_old_paras", "doc_id long, para_idx long, para_text string, mark string", [(1, 0, "One  two", "got"), (1, 1, "Three", "confusing"), (1, 2, "one two", "confusing"), (1, 3, "Four", None), (2, 0, "Three", "got")])
NEW_PARAS = X.Fixture("fx_new_paras", "doc_id long, para_idx long, para_text string", [(1, 0, "New"), (1, 1, "ONE TWO "), (1, 2, "three"), (1, 3, "Four"), (2, 0, "Three changed")])
WEAK = X.Fixture("fx_weak", "doc_id long, missed string, weak string", [(1, "pump|valve", "hose|pump|flow"), (2, "a", "a"), (3, "", "x")])
DECK = X.Fixture("fx_deck", "card_id long, due_min double", [(1, 100.0), (2, 12000.0), (3, 12001.0)])
DOCTOR = X.Fixture("fx_doctor", "doc_id long, issue_id string, rule string, start long", [(1, "a", "units.plural", 3), (1, "a", "units.case", 9), (1, "b", "figures.order", 4), (1, "c", "units.mixed", 5), (2, "d", "tense.mixed", 1)])
CHECKS = ["units", "abbr", "figures", "tense", "claims", "structure"]
SWAPS = X.Fixture("fx_swaps", "id long, statement string, a string, b string", [(1, "The pump feeds the valve.", "pump", "valve"), (2, "Heat warms water and water cools heat.", "water", "heat"), (3, "Nothing here.", "x", "y")])
PROMPTS = ["Explain it.", "Why does it matter?", "Give an example."]
REWRITE = X.Fixture("fx_rewrite", "doc_id long, start long, end long, section string, n_words long", [(1, 0, 20, "body", 5), (1, 21, 40, "references", 6), (1, 41, 60, "body", 2), (2, 0, 10, "body", 4), (2, 11, 31, "heading", 4), (2, 32, 52, "results", 4)])
BARRED = X.Fixture("fx_barred", "doc_id long, start long, end long", [(1, 0, 5), (1, 5, 8), (2, 0, 6), (2, 33, 40), (3, 0, 9)])


def protected_kinds(spark, sf_dir):
    return D.protected(TEXTS.df(spark, sf_dir), KEEP).drop("_row")


def protected_kinds_merged(spark, sf_dir):
    return D.protected_islands(D.protected(TEXTS.df(spark, sf_dir), KEEP)).drop("_row")


def protected_documents(spark, sf_dir):
    """Spans of every kind in all documents, merged."""
    return D.protected_islands(D.protected(docs(spark, sf_dir))).drop("_row")


def issues_fixture(spark, sf_dir):
    return D.analyse(TEXTS.df(spark, sf_dir))


def issues(spark, sf_dir):
    return D.analyse(docs(spark, sf_dir)).select("doc_id", "issue_id", "rule", "severity", "start", "end")


def rewritable_sentences(spark, sf_dir):
    return D.rewritable(REWRITE.df(spark, sf_dir), BARRED.df(spark, sf_dir))


def doctor_counts(spark, sf_dir):
    return D.doctor_counts(DOCTOR.df(spark, sf_dir), CHECKS)


def stock_openers(spark, sf_dir):
    return FLOW.df(spark, sf_dir).select("doc_id", "sent_idx", FL.opening_transition(F.col("sentence")).alias("transition"), FL.stock_opener_length(F.col("sentence")).cast("long").alias("n"))


def crowded_transitions(spark, sf_dir):
    return FL.crowded_transitions(FLOW.df(spark, sf_dir))


def opener_triggers(spark, sf_dir):
    return FL.opener_triggers(FLOW.df(spark, sf_dir))


def opener_triggers_documents(spark, sf_dir):
    return FL.opener_triggers(sentences(docs(spark, sf_dir)))


def first_mention_order(spark, sf_dir):
    return FL.first_mention_order(MENTIONS.df(spark, sf_dir))


def sectioned_lines(spark, sf_dir):
    return FL.with_sections(LINES.df(spark, sf_dir)).select("doc_id", "line_idx", "heading", "section", "in_body")


def report_findings(spark, sf_dir):
    """Long abstracts (over five words here), lines in the minority tense, and quantities without units."""
    lines = LINES.df(spark, sf_dir)
    rows = FL.long_abstracts(lines, 5).select("doc_id", F.lit("abstract_long").alias("rule"), F.col("n_words").cast("long").alias("at"))
    rows = rows.unionByName(FL.tense_votes(lines).select("doc_id", F.lit("tense").alias("rule"), F.col("line_idx").alias("at")))
    return rows.unionByName(FL.missing_units(lines).select("doc_id", F.lit("units.missing").alias("rule"), F.col("line_idx").alias("at")))


def rhythm_series(spark, sf_dir):
    return FL.rhythm_series(sentences(docs(spark, sf_dir))).select("doc_id", "sent_idx", "n_words", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def short_pairs(spark, sf_dir):
    return FL.short_pairs(FLOW.df(spark, sf_dir))


def short_pairs_documents(spark, sf_dir):
    return FL.short_pairs(sentences(docs(spark, sf_dir)))


def assembled_changes(spark, sf_dir):
    return FL.assembled_changes(CHANGES.df(spark, sf_dir)).select("doc_id", "change_id", "new_start", "new_end")


def pending_changes(spark, sf_dir):
    return FL.pending_changes(EDITED.df(spark, sf_dir), CHANGES.df(spark, sf_dir))


def bulk_accepted(spark, sf_dir):
    return CL.bulk_accepted(CHANGES.df(spark, sf_dir))


def zipf_tiers(spark, sf_dir):
    """Types and tokens of each frequency tier of the English documents."""
    return FT.word_frequencies(docs(spark, sf_dir).where("lang = 'en'")).groupBy("tier").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"), F.round(F.min("zipf"), 4).alias("least"))


def plainness(spark, sf_dir):
    en = docs(spark, sf_dir).where("lang = 'en'")
    return FT.plainness(en, FT.word_frequencies(en)).select("doc_id", F.round("plainness", 4).alias("plainness"))


def fits(spark, sf_dir):
    """Tone, voice, style, fluency and confidence of candidates."""
    rates = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    rows = FITS.df(spark, sf_dir).withColumn("tone_fit", FT.tone_fit(F.col("text"), F.col("tone"), F.col("want"))).withColumn("voice_fit", FT.voice_fit(F.col("text"), rates, F.col("commas")))
    rows = rows.withColumn("fluency", FT.fluency_norm(F.col("original"), F.col("candidate")))
    style = FT.style_fit(F.col("hits"), F.col("length"), F.col("tone_fit"), F.lit(0.5), F.col("repeats"), F.col("voice_fit"))
    r = lambda c: F.round(c, 6)
    return rows.select("id", r("tone_fit").alias("tone_fit"), r("voice_fit").alias("voice_fit"), r(style).alias("style_fit"), r("fluency").alias("fluency"), r(FT.fluency_drop(F.col("original"), F.col("candidate"))).alias("drop"), FT.confidence(F.col("meaning"), F.col("fluency")).alias("confidence"))


def compatible_edits(spark, sf_dir):
    return FT.compatible_pairs(EDIT_SET.df(spark, sf_dir))


def capped_candidates(spark, sf_dir):
    return FT.capped_candidates(CANDIDATES.df(spark, sf_dir)).select("doc_id", "sent_idx", "cand_idx", "text", F.col("rank").cast("long"))


def rejection_counts(spark, sf_dir):
    return FT.rejections(CANDIDATES.df(spark, sf_dir))


def frequent_terms(spark, sf_dir):
    return FT.frequent_terms(docs(spark, sf_dir))


def quiz_totals(spark, sf_dir):
    return CL.quiz_totals(CL.graded(QUIZ.df(spark, sf_dir), GIVEN.df(spark, sf_dir)))


def study_cards(spark, sf_dir):
    return CL.cards_from(CL.graded(QUIZ.df(spark, sf_dir), GIVEN.df(spark, sf_dir)), TERMS.df(spark, sf_dir))


def marks_carried(spark, sf_dir):
    return CL.marks_carried(OLD_PARAS.df(spark, sf_dir), NEW_PARAS.df(spark, sf_dir))


def revision_list(spark, sf_dir):
    return CL.revision_list(WEAK.df(spark, sf_dir))


def dashboard(spark, sf_dir):
    return CL.dashboard(X.REVIEWS.df(spark, sf_dir), DECK.df(spark, sf_dir), 12000.0)


def swapped_statements(spark, sf_dir):
    return SWAPS.df(spark, sf_dir).select("id", CL.swap_terms(F.col("statement"), F.col("a"), F.col("b")).alias("swapped"), CL.picked(F.col("statement"), PROMPTS).alias("prompt"))


PAIRS = X.Fixture("fx_pairs", "id long, old string, new string, start long, end long, replacement string", [
    (1, "the quick fox", "the slow fox", 4, 9, "slow"), (2, "the fox", "the fox", None, None, None), (3, "a b", "a b c", 3, 3, " c"), (4, "walked home", "walking home", 0, 6, "walking"), (5, "", "new", 0, 0, "new"), (6, "old", "", 0, 3, ""),
    (7, "to to to", "to to", 5, 8, ""), (8, "one, two", "one; two", 3, 4, ";"), (9, None, "x", None, None, None), (10, "x y z", "q y r", 0, 5, "q y r"),
])
OFFSETS = X.Fixture("fx_shift", "doc_id long, offset long", [(1, 10), (2, -3)])


def minimal_edits(spark, sf_dir):
    """Edits of the fixture; its last columns are what they must be."""
    edit = minimal_edit(F.col("old"), F.col("new"))
    return PAIRS.df(spark, sf_dir).select("id", edit.alias("e")).select("id", "e.start", "e.end", "e.replacement")


def shifted_spans(spark, sf_dir):
    return S.shift_spans(X.SPANS.df(spark, sf_dir), OFFSETS.df(spark, sf_dir))


def fingerprints(spark, sf_dir):
    return fingerprints_of(docs(spark, sf_dir), "source")


def report_issues(spark, sf_dir):
    return SV.report_issues(X.REPORT.df(spark, sf_dir))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and f.__code__.co_varnames[:2] == ("spark", "sf_dir")}


def text_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans_sql(name: str, source: str, patterns: dict[str, str]) -> str:
    """Common table expressions that end in `name` (doc_id, kind, start, end, surface): gaps and matches alternate."""
    per = " UNION ALL ".join(f"SELECT doc_id, {text_sql(k)} AS kind, regexp_extract_all(text, {text_sql(p)}) AS m, string_split_regex(text, {text_sql(p)}) AS g FROM {source} WHERE text <> ''" for k, p in patterns.items())
    return f"""{name}_p AS ({per}), {name}_u AS (SELECT doc_id, kind, m, g, unnest(range(1, len(m) + 1)) AS k FROM {name}_p),
{name}_e AS (SELECT doc_id, kind, m[k] AS surface, sum(length(g[k]) + length(m[k])) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS "end" FROM {name}_u),
{name} AS (SELECT doc_id, kind, "end" - length(surface) AS start, "end", surface FROM {name}_e)"""


#: Letters beyond ASCII are word characters for \\b in Spark but not in DuckDB, so there they become underscores, which are.
MASKED = "(SELECT doc_id, regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', '_', 'g') AS text FROM documents)"
KINDS = D.DETECTORS | {"keep": D.keep_pattern(KEEP)}


def issues_sql(source: str) -> str:
    """Issues as analyse() defines them, over a table with text."""
    rules = ", ".join(f"({text_sql(r)}, {text_sql(c)}, {text_sql(v)}, {text_sql(m)})" for r, (_, c, v, m) in D.RULES.items())
    plain = ", ".join(f"({text_sql(n)}, {text_sql(p)}, {text_sql(w)})" for n in ("wordy_phrase", "filler") for p, w in LEXICONS[n].items())
    return f"""{spans_sql('hits', source, {r: p for r, (p, *_) in D.RULES.items()})}, {spans_sql('hard', source, {k: D.DETECTORS[k] for k in D.HARD})},
ab(rule, category, severity, message) AS (VALUES {rules}), pl(rule, phrase, plain) AS (VALUES {plain}),
fr AS (SELECT h.*, list_position([{', '.join(text_sql(r) for r in PRIORITY)}], kind) AS rk FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hard b WHERE b.doc_id = h.doc_id AND h.start < b."end" AND b.start < h."end")),
on_ AS (SELECT * FROM fr WHERE rk IS NOT NULL AND rk > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY rk, kind) = 1),
kp AS (SELECT * FROM fr WHERE rk IS NULL OR rk = 0 UNION ALL SELECT * FROM on_ a WHERE NOT EXISTS (SELECT 1 FROM on_ b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND a."end" <= b."end" AND (b.start <> a.start OR b."end" <> a."end") AND b.rk <= a.rk)),
iss AS (SELECT doc_id, substr(sha1(kind || ':' || start || ':' || "end"), 1, 10) AS issue_id, kind AS rule, category, severity, start, "end", surface,
  CASE WHEN regexp_matches(surface, '^[A-Z]') THEN upper(substr(plain, 1, 1)) || substr(plain, 2) ELSE plain END AS suggestion, message FROM kp JOIN ab ON ab.rule = kind LEFT JOIN pl ON pl.rule = kind AND pl.phrase = lower(surface))"""


_HEAD = "regexp_replace(regexp_replace(line, '^\\s*[0-9]+(?:\\.[0-9]+)*[.)]?\\s+', ''), '[:\\s]+$', '')"
_SECT = "CASE lower(trim(" + _HEAD + ")) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FL.section_of.__globals__["SECTIONS"].items()) + " END"
def _lined(fixture: X.Fixture) -> str:
    return f"""{fixture.cte()}, ln AS (SELECT *, {_SECT} AS sec FROM {fixture.name}),
ls AS (SELECT doc_id, line_idx, line, sec IS NOT NULL AS heading, coalesce(last_value(sec IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_idx), 'body') AS section FROM ln),
v AS (SELECT *, CASE WHEN p AND NOT q THEN 1 WHEN q AND NOT p THEN -1 ELSE 0 END AS vote FROM (SELECT *, regexp_matches(line, {text_sql(FL.PAST)}) AS p, regexp_matches(line, {text_sql(FL.PRESENT)}) AS q FROM ls WHERE NOT heading AND section <> 'references')),
tv AS (SELECT *, sum(vote) OVER (PARTITION BY doc_id, section) AS total FROM v),
al AS (SELECT doc_id, sum(len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')))::BIGINT AS n_words FROM ls WHERE section = 'abstract' AND NOT heading GROUP BY doc_id),
mu AS (SELECT doc_id, line_idx FROM ls WHERE section IN ('results', 'discussion') AND NOT heading AND regexp_matches(line, {text_sql(FL.QUANTITY)}) AND NOT regexp_matches(trim(regexp_extract(line, {text_sql(FL.QUANTITY)}, 1)), '^(?:%|°|[A-Za-z]{{1,3}})'))"""


_OPEN = text_sql(FL.OPENING)
_TRANS = f"nullif(lower(regexp_extract(sentence, {_OPEN}, 1)), '')"
_FREQ = f"{WORDS.replace('FROM documents', "FROM documents WHERE lang = 'en'")}, wl AS (SELECT doc_id, lower(unnest(w)) AS word FROM w), wc AS (SELECT word, count(*) AS n FROM wl GROUP BY 1), zf AS (SELECT word, n, log10(n * 1e9::DOUBLE / (SELECT sum(n) FROM wc)::DOUBLE) AS z FROM wc)"


def _pairs_sql(source: str) -> str:
    return f"""nx AS (SELECT *, lead(sentence) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS nxt, lead(n_words) OVER (PARTITION BY doc_id, para_idx ORDER BY sent_idx) AS nn FROM {source})
SELECT doc_id, sent_idx, regexp_replace(sentence, '[.!]\\s*$', '') || ', and ' || lower(substr(nxt, 1, 1)) || substr(nxt, 2) AS merged FROM nx WHERE n_words <= 6 AND nn <= 6 AND NOT regexp_matches(sentence, '\\?\\s*$')"""


def _triggers_sql(source: str) -> str:
    return f"""op AS (SELECT doc_id, sent_idx, lower(regexp_extract(sentence, '[A-Za-z]+')) AS opener FROM {source}),
bk AS (SELECT *, list(opener) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS b FROM op)
SELECT doc_id, sent_idx, opener FROM bk WHERE len(list_filter(b, lambda x: x = opener)) >= 3"""


def _prints_sql() -> str:
    listed = lambda words: ", ".join(f"'{w}'" for w in words)
    marks = ", ".join(f"sum(len(regexp_extract_all(text, {text_sql(p)})))::DOUBLE AS {m}" for m, p in FP.MARKS.items())
    opener = "lower(regexp_extract(sentence, '[A-Za-z]+'))"
    flag = lambda test, name: f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)::DOUBLE AS {name}"
    return f"""WITH {SENTENCES}, {WORDS}, st AS (SELECT source, count(*)::DOUBLE AS sents, sum(len(words))::DOUBLE AS len1, sum(len(words) * len(words))::DOUBLE AS len2, {flag('len(words) > 30', 'lg')}, {flag('len(words) < 8', 'sh')},
{flag(f'{opener} IN ({listed(FP.PRONOUNS)})', 'po')}, {flag(f"{opener} IN ('the', 'a', 'an')", 'ao')}, {flag(f'regexp_matches(sentence, {_OPEN})', 'tr')}, {flag(f'regexp_matches(sentence, {text_sql(FP.PASSIVE)})', 'pa')} FROM sents JOIN documents USING (doc_id) GROUP BY 1),
wt AS (SELECT source, count(*)::DOUBLE AS words, sum(length(x))::DOUBLE AS letters, {flag('length(x) > 6', 'lw')}, {flag(f'lower(x) IN ({listed(FP.FIRST)})', 'fi')} FROM (SELECT source, unnest(w) AS x FROM w JOIN documents USING (doc_id)) GROUP BY 1),
mk AS (SELECT source, {marks} FROM documents GROUP BY 1)
SELECT source, words::BIGINT AS n_words, round(len1 / sents, 4) AS length_mean, round(sqrt(greatest(len2 / sents - (len1 / sents) * (len1 / sents), 0.0::DOUBLE)), 4) AS length_sd, round(letters / words, 4) AS word_length, round(lw / words, 4) AS long_word_share, round(1000.0::DOUBLE * fi / words, 4) AS first_person_per_1000,
round(lg / sents, 4) AS long_share, round(sh / sents, 4) AS short_share, round(po / sents, 4) AS pronoun_opener_share, round(ao / sents, 4) AS article_opener_share, round(tr / sents, 4) AS transition_share, round(pa / sents, 4) AS passive_share,
{", ".join(f"round(1000.0::DOUBLE * {m} / words, 4) AS {m}_per_1000" for m in FP.MARKS)} FROM st JOIN wt USING (source) JOIN mk USING (source) WHERE words >= 300"""


_MAP = "MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in RATES.items()) + "}"
_GRADED = f"""{QUIZ.cte()}, {GIVEN.cte()}, gr AS (SELECT q.doc_id, q.qid, prompt, key, score, CASE WHEN key IS NOT NULL THEN lower(trim(coalesce(answer, ''))) = lower(key) END AS correct FROM fx_quiz q LEFT JOIN fx_given a ON a.doc_id = q.doc_id AND a.qid = q.qid)"""
ORACLES = {
    "protected_kinds": f"WITH {TEXTS.cte()}, {spans_sql('found', 'fx_texts', KINDS)} SELECT * FROM found",
    "protected_kinds_merged": f"WITH {TEXTS.cte()}, {spans_sql('found', 'fx_texts', KINDS)}, {_islands_sql('found', '>=', list(KINDS)).strip()}",
    "protected_documents": f"WITH {spans_sql('found', MASKED, D.DETECTORS)}, {_islands_sql('found', '>=', list(D.DETECTORS)).strip()}",
    "issues_fixture": f"WITH {TEXTS.cte()}, {issues_sql('fx_texts')} SELECT * FROM iss",
    "issues": f"WITH {issues_sql(MASKED)} SELECT doc_id, issue_id, rule, severity, start, \"end\" FROM iss",
    "rewritable_sentences": f"""WITH {REWRITE.cte()}, {BARRED.cte()}, sh AS (SELECT s.doc_id, s.start, s."end", section, n_words, coalesce(sum(least(s."end", b."end") - greatest(s.start, b.start)), 0) / greatest(s."end" - s.start, 1)::DOUBLE AS share
FROM fx_rewrite s LEFT JOIN fx_barred b ON b.doc_id = s.doc_id AND s.start < b."end" AND b.start < s."end" GROUP BY s.doc_id, s.start, s."end", section, n_words) SELECT doc_id, start, "end", share FROM sh WHERE section NOT IN ('heading', 'references') AND n_words >= 3 AND share < 0.6""",
    "doctor_counts": f"""WITH {DOCTOR.cte()}, o AS (SELECT * FROM fx_doctor QUALIFY row_number() OVER (PARTITION BY doc_id, issue_id ORDER BY start, rule) = 1)
SELECT d.doc_id, c AS "check", count(o.rule) AS n FROM (SELECT DISTINCT doc_id FROM fx_doctor) d CROSS JOIN (SELECT unnest({CHECKS!r}) AS c) LEFT JOIN o ON o.doc_id = d.doc_id AND split_part(o.rule, '.', 1) = c GROUP BY 1, 2""",
    "stock_openers": f"""WITH {FLOW.cte()}, l AS (SELECT *, length(regexp_extract(sentence, {text_sql(FL.STOCK_OPENER)})) AS k FROM fx_flow)
SELECT doc_id, sent_idx, {_TRANS} AS transition, (CASE WHEN len(list_filter(string_split_regex(substr(sentence, k + 1), '\\s+'), lambda w: w <> '')) >= 6 THEN k ELSE 0 END)::BIGINT AS n FROM l""",
    "crowded_transitions": f"""WITH {FLOW.cte()}, t AS (SELECT *, {_TRANS} AS transition FROM fx_flow),
w AS (SELECT doc_id, sent_idx, transition, coalesce(list_contains(list(transition) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), transition), false) AS repeated, count(transition) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 1 AS dense FROM t)
SELECT * FROM w WHERE transition IS NOT NULL AND (repeated OR dense)""",
    "opener_triggers": f"WITH {FLOW.cte()}, {_triggers_sql('fx_flow')}",
    "opener_triggers_documents": f"WITH {SENTENCES}, {_triggers_sql('sents')}",
    "first_mention_order": f"""WITH {MENTIONS.cte()}, f AS (SELECT doc_id, kind, number, min(start) AS start FROM fx_mentions GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY start) AS place FROM f)
SELECT doc_id, kind, number, place FROM r WHERE number > place AND NOT EXISTS (SELECT 1 FROM r b WHERE b.doc_id = r.doc_id AND b.kind = r.kind AND b.place < r.place AND b.number = r.number - 1)""",
    "sectioned_lines": f"WITH {_lined(LINES)} SELECT doc_id, line_idx, heading, section, NOT heading AND section <> 'references' AS in_body FROM ls",
    "report_findings": f"""WITH {_lined(LINES)} SELECT doc_id, 'abstract_long' AS rule, n_words AS "at" FROM al WHERE n_words > 5 UNION ALL SELECT doc_id, 'tense', line_idx FROM tv WHERE vote <> 0 AND vote * total < 0 UNION ALL SELECT doc_id, 'units.missing', line_idx FROM mu""",
    "report_issues": f"""WITH {_lined(X.REPORT)} SELECT doc_id, 'structure.abstract_long' AS rule, n_words::VARCHAR AS about FROM al WHERE n_words > 250 UNION ALL SELECT doc_id, 'tense.mixed', section || ':' || line_idx FROM tv WHERE vote <> 0 AND vote * total < 0
UNION ALL SELECT doc_id, 'units.missing', line_idx::VARCHAR FROM mu UNION ALL SELECT doc_id, rule, section FROM ({RULES['report_structure']}) UNION ALL SELECT doc_id, rule, abbr FROM ({RULES['report_abbreviations']})
UNION ALL SELECT doc_id, rule, kind || ' ' || number FROM ({RULES['report_figures']}) UNION ALL SELECT doc_id, rule, surface FROM ({RULES['report_units']})""",
    "rhythm_series": f"WITH {SENTENCES} SELECT doc_id, sent_idx, len(words)::BIGINT AS n_words, round(avg(len(words)) OVER (PARTITION BY doc_id), 4) AS mean, round(stddev_pop(len(words)) OVER (PARTITION BY doc_id), 4) AS sd FROM sents",
    "short_pairs": f"WITH {FLOW.cte()}, {_pairs_sql('fx_flow')}",
    "short_pairs_documents": f"WITH {SENTENCES}, {_pairs_sql('(SELECT *, len(words) AS n_words FROM sents)')}",
    "assembled_changes": f"""WITH {CHANGES.cte()}, d AS (SELECT *, coalesce(sum(length(replacement) - ("end" - start)) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM fx_changes)
SELECT doc_id, change_id, (start + k)::BIGINT AS new_start, (start + k + length(replacement))::BIGINT AS new_end FROM d""",
    "pending_changes": f"""WITH {CHANGES.cte()}, {EDITED.cte()}, d AS (SELECT c.*, (start + coalesce(sum(CASE WHEN decision = 'accepted' THEN length(replacement) - length(original) ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, change_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS p FROM fx_changes c),
n AS (SELECT d.*, text, greatest(0, p - 300) AS lo, instr(substr(text, greatest(0, p - 300) + 1, p - greatest(0, p - 300) + length(original) + 300), original) AS f FROM d JOIN fx_edited e USING (doc_id) WHERE decision IS NULL)
SELECT doc_id, change_id, (CASE WHEN substr(text, p + 1, length(original)) = original THEN p WHEN trim(original) <> '' AND f > 0 THEN lo + f - 1 END)::BIGINT AS new_start FROM n""",
    "bulk_accepted": f"""WITH {CHANGES.cte()} SELECT doc_id, change_id FROM fx_changes c WHERE decision IS NULL AND confidence >= 0.8 AND NOT EXISTS (SELECT 1 FROM fx_changes o WHERE o.doc_id = c.doc_id AND o.change_id <> c.change_id AND c.start < o."end" AND o.start < c."end")""",
    "zipf_tiers": f"WITH {_FREQ} SELECT CASE WHEN z < 3 THEN 0 WHEN z < 4 THEN 1 WHEN z < 5 THEN 2 ELSE 3 END AS tier, count(*) AS n_types, sum(n)::BIGINT AS n_tokens, round(min(z), 4) AS least FROM zf GROUP BY 1",
    "plainness": f"""WITH {_FREQ}, ml AS (SELECT doc_id, avg(z) AS m FROM wl JOIN zf USING (word) WHERE length(word) > 3 GROUP BY 1)
SELECT d.doc_id, round(coalesce(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (m - 3.0::DOUBLE) / 2.5::DOUBLE)), 0.5::DOUBLE), 4) AS plainness FROM documents d LEFT JOIN ml ON ml.doc_id = d.doc_id WHERE d.lang = 'en'""",
    "fits": f"""WITH {FITS.cte()}, m AS (SELECT *, len(regexp_extract_all(text, {text_sql(FT.CONTRACTION)}))::DOUBLE AS n, regexp_matches(text, {text_sql(FT.CASUAL_OPENER)}) AS co, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z''’-]*'), lambda x: lower(x)) AS w, {_MAP} AS mp, length(text) - length(replace(text, ',', '')) AS cm FROM fx_fits),
t AS (SELECT *, CASE WHEN want IS NOT NULL THEN 0.7 * (1 - least(1.0, abs(n - want) / 2)) + 0.3 * CASE WHEN NOT co OR tone = 'casual' THEN 1.0 ELSE 0.5 END WHEN tone = 'academic' THEN 1 - least(1.0, 0.5 * n + CASE WHEN co THEN 0.3 ELSE 0.0 END) WHEN tone = 'casual' THEN least(1.0, 0.6 + 0.2 * n) ELSE 1 - least(0.5, 0.2 * n) END AS tf,
CASE WHEN len(w) > 0 THEN greatest(0.0, least(1.0, 0.6 + 0.4 * least(1.0, len(list_filter(w, lambda x: coalesce(mp[x] >= 8.0, false))) / greatest(1.0, len(w) * 0.35)) - 0.3 * least(1.0, len(list_filter(w, lambda x: coalesce(mp[x] < 1.0, false))) / 3.0) - CASE WHEN commas IS NOT NULL THEN 0.1 * least(1.0, abs(cm - commas) / 3) ELSE 0.0 END)) END AS vf, greatest(0.0, least(1.0, 0.5 + 0.5 * (candidate - original))) AS fl FROM m),
y AS (SELECT *, 0.45 * pow(0.5, hits) + 0.25 * length + 0.15 * tf + 0.15 * 0.5 + CASE WHEN repeats IS NULL THEN 0.0 ELSE 0.1 * CASE repeats WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END END AS tt, 1.0 + CASE WHEN repeats IS NULL THEN 0.0 ELSE 0.1 END AS ww FROM t)
SELECT id, round(tf, 6) AS tone_fit, round(vf, 6) AS voice_fit, round((CASE WHEN vf IS NULL THEN tt / ww ELSE (0.75 * tt + 0.25 * vf) / (0.75 * ww + 0.25) END)::DOUBLE, 6) AS style_fit, round(fl, 6) AS fluency,
round((CASE WHEN candidate >= original OR original >= 0 THEN 0.0 ELSE (original - candidate) / abs(original) END)::DOUBLE, 6) AS "drop", round(greatest(0.05, least(0.99, 0.25 + 0.45 * greatest(0.0, least(1.0, (meaning - 0.8) / (1.0 - 0.8))) + 0.3 * fl))::DOUBLE, 2) AS confidence FROM y""",
    "minimal_edits": f"WITH {PAIRS.cte()} SELECT id, start, \"end\", replacement FROM fx_pairs",
    "shifted_spans": f'WITH {X.SPANS.cte()}, {OFFSETS.cte()} SELECT s.doc_id, s.start + coalesce("offset", 0) AS start, s."end" + coalesce("offset", 0) AS "end", kind FROM fx_spans s LEFT JOIN fx_shift o ON o.doc_id = s.doc_id',
    "fingerprints": _prints_sql(),
    "compatible_edits": f"""WITH {EDIT_SET.cte()} SELECT a.doc_id, a.edit_id AS a, b.edit_id AS b FROM fx_edit_set a JOIN fx_edit_set b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.edit_id < b.edit_id AND (a."end" < b.start OR b."end" < a.start)""",
    "capped_candidates": f"""WITH {CANDIDATES.cte()}, o AS (SELECT * FROM fx_candidates QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, text ORDER BY n_edits DESC, cand_idx) = 1)
SELECT doc_id, sent_idx, cand_idx, text, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY n_edits > 1 DESC, cand_idx) AS rank FROM o QUALIFY rank <= 7""",
    "rejection_counts": f"WITH {CANDIDATES.cte()} SELECT rejected AS reason, count(*) AS n FROM fx_candidates WHERE rejected IS NOT NULL GROUP BY 1",
    "frequent_terms": f"""WITH {WORDS}, c AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, lower(unnest(w)) AS word FROM w) WHERE length(word) >= 6 GROUP BY 1, 2)
SELECT doc_id, word, n, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word))::INTEGER AS rank FROM c QUALIFY rank <= 5""",
    "quiz_totals": f"WITH {_GRADED} SELECT doc_id, round((CASE WHEN count(correct) > 0 THEN 100.0 * sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(correct) ELSE avg(coalesce(score, 0.0)) END)::DOUBLE, 1) AS total FROM gr GROUP BY 1",
    "study_cards": f"""WITH {_GRADED}, {TERMS.cte()}, al AS (SELECT 'q:' || doc_id || ':' || qid AS card_id, doc_id, 'quiz' AS source, prompt AS front, key AS back FROM gr WHERE correct = false UNION ALL SELECT 'g:' || doc_id || ':' || lower(term), doc_id, 'glossary', 'Define: ' || term, definition FROM fx_terms WHERE definition <> '')
SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY front, back) = 1""",
    "marks_carried": f"""WITH {OLD_PARAS.cte()}, {NEW_PARAS.cte()}, m AS (SELECT doc_id, lower(trim(regexp_replace(para_text, '\\s+', ' ', 'g'))) AS k, arg_max(mark, para_idx) AS mark FROM fx_old_paras WHERE mark IS NOT NULL GROUP BY 1, 2)
SELECT n.doc_id, para_idx, mark FROM fx_new_paras n JOIN m ON m.doc_id = n.doc_id AND m.k = lower(trim(regexp_replace(para_text, '\\s+', ' ', 'g')))""",
    "revision_list": f"""WITH {WEAK.cte()}, u AS (SELECT doc_id, unnest(string_split(missed, '|') || string_split(weak, '|')) AS t, generate_subscripts(string_split(missed, '|') || string_split(weak, '|'), 1) AS i FROM fx_weak), f AS (SELECT doc_id, t, min(i) AS i FROM u GROUP BY 1, 2)
SELECT doc_id, string_agg(t, '|' ORDER BY i) AS topics FROM f GROUP BY 1""",
    "dashboard": f"""WITH {X.REVIEWS.cte()}, {DECK.cte()} SELECT (SELECT count(*) FROM fx_deck) AS cards, (SELECT count(*) FROM fx_deck WHERE due_min <= 12000) AS due, count(*) AS reviews, round(avg((grade >= 2)::INTEGER), 4) AS passed FROM fx_reviews WHERE at_min > 12000 - 7 * 1440 AND at_min <= 12000""",
    "swapped_statements": f"""WITH {SWAPS.cte()} SELECT id, replace(replace(replace(statement, a, chr(1)), b, a), chr(1), b) AS swapped, ({PROMPTS!r})[(('0x' || substr(sha1(statement), 1, 7))::BIGINT % 3 + 1)::INTEGER] AS prompt FROM fx_swaps""",
}
