"""Queries on spans, language model, style, assessment, reviews and ownership, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as C
from ..functions.text import find_spans
from ..operators import assessment as A
from ..operators import language_model as LM
from ..operators import packed_model as PM
from ..operators import metrics as M
from ..operators import ownership as O
from ..operators import reviews as R
from ..operators import spans as S
from ..operators import stylometry as ST
from . import fixtures as X
from .queries_text import RUNS, SENTENCES, WORDS, docs

PATTERNS = {
    "number": r"[0-9]+(?:[.,][0-9]+)*",
    "email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
    "quote": r'"[^"\n]{1,400}"',
    "caps": r"[A-Z]{2,6}",
    "math": r"[$][^$\n]+[$]",
}
PRIORITY = ["code", "quote", "citation", "url", "number", "keep", "term"]


def protected_spans(spark, sf_dir):
    return find_spans(docs(spark, sf_dir), PATTERNS)


def protected_merged(spark, sf_dir):
    found = find_spans(docs(spark, sf_dir), PATTERNS, keep=("_row",))
    return S.merge_by_priority(found, list(PATTERNS), ("_row", "doc_id")).drop("_row")


def span_merge(spark, sf_dir):
    return S.merge_spans(X.SPANS.df(spark, sf_dir))


def span_priority(spark, sf_dir):
    return S.merge_by_priority(X.SPANS.df(spark, sf_dir).where("start < end"), PRIORITY)


def span_joins(spark, sf_dir):
    """Overlap (semi and anti), containment and clipping of the fixture's spans against its windows."""
    s, w = X.SPANS.df(spark, sf_dir), X.WINDOWS.df(spark, sf_dir)
    rows = [S.with_overlap(s, w).withColumn("op", F.lit("overlap")), S.without_overlap(s, w).withColumn("op", F.lit("anti")), S.fully_covered(s, w).withColumn("op", F.lit("covered"))]
    clip = S.clipped(s, w).select("doc_id", "start", "end", F.col("window_id").cast("string").alias("kind"), F.lit("clip").alias("op"))
    out = clip
    for r in rows:
        out = out.unionByName(r.select("doc_id", "start", "end", "kind", "op"))
    return out


def edits_applied(spark, sf_dir):
    return S.apply_edits(X.EDIT_DOCS.df(spark, sf_dir), X.EDITS.df(spark, sf_dir))


def offsets_mapped(spark, sf_dir):
    return S.map_offsets(X.OFFSETS.df(spark, sf_dir), X.EDITS.df(spark, sf_dir))


def ngram_counts(spark, sf_dir):
    """Trigrams of the English documents that occur twice or more."""
    counts = LM.count_ngrams(docs(spark, sf_dir).where("lang = 'en'"), {3: 2})
    return counts[3].select(F.md5("gram").alias("digest"), "n")


def fluency_fixture(spark, sf_dir):
    scored = LM.score_texts(X.LM_TESTS.df(spark, sf_dir), LM.count_ngrams(X.LM_CORPUS.df(spark, sf_dir)))
    return scored.select("id", "n_tokens", F.round("logprob", 6).alias("logprob"), F.round("slor", 6).alias("slor"))


def fluency(spark, sf_dir):
    """SLOR of the benchmark's texts under a model of the English documents."""
    texts = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("id"), "text")
    scored = PM.score_texts(texts, PM.fit_packed(docs(spark, sf_dir).where("lang = 'en'"), PM.MOST_WORDS))
    return scored.select("id", "n_tokens", F.round("logprob", 6).alias("logprob"), F.round("slor", 6).alias("slor"))


def function_word_rates(spark, sf_dir):
    return ST.function_word_rates(docs(spark, sf_dir), "source").select("source", "word", "n_words", F.round("rate", 4).alias("rate"))


def style_reference(spark, sf_dir):
    return ST.reference_statistics(docs(spark, sf_dir).where("lang = 'en'"), 200).select("word", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def style_delta(spark, sf_dir):
    """Burrows' Delta of every source to source src1."""
    d = docs(spark, sf_dir).where("lang = 'en'")
    rates = ST.function_word_rates(d, "source")
    return ST.burrows_delta(rates, rates.where("source = 'src1'"), ST.reference_statistics(d, 200), "source").select("source", F.round("delta", 4).alias("delta"))


def style_reference_corpus(spark, sf_dir):
    """Statistics over chunks of 1,000 words that run across the English documents."""
    return ST.corpus_statistics(docs(spark, sf_dir).where("lang = 'en'")).select("word", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


def style_delta_corpus(spark, sf_dir):
    """style_delta against the statistics of style_reference_corpus."""
    d = docs(spark, sf_dir).where("lang = 'en'")
    rates = ST.function_word_rates(d, "source")
    return ST.burrows_delta(rates, rates.where("source = 'src1'"), ST.corpus_statistics(d), "source").select("source", F.round("delta", 4).alias("delta"))


def _features(d):
    p = M.punctuation_rates(d)
    r = M.rhythm(d).select("doc_id", F.col("length_mean").alias("sentence_length_mean"), "sentence_length_sd")
    return r.join(p.select("doc_id", "word_length_mean", "commas_per_sentence"), "doc_id")


#: A writer's profile for the fixed comparison.
PROFILE = {"sentence_length_mean": 11.0, "sentence_length_sd": 6.0, "word_length_mean": 4.6, "commas_per_sentence": 0.4}


def style_distance(spark, sf_dir):
    return ST.feature_distance(_features(docs(spark, sf_dir)), PROFILE, "doc_id").select("doc_id", F.round("rms", 4).alias("rms"))


def style_differences(spark, sf_dir):
    top = ST.top_differences(_features(docs(spark, sf_dir)), PROFILE, "doc_id")
    return top.select("doc_id", F.col("rank").cast("long"), "feature", M.rounded(F.col("z"), 4).alias("z"))


def voice_match(spark, sf_dir):
    """Match of every English document with a profile of source src1."""
    d = docs(spark, sf_dir).where("lang = 'en'")
    profile = ST.function_word_rates(d.where("source = 'src1'"), "source")
    delta = ST.burrows_delta(ST.function_word_rates(d), profile, ST.corpus_statistics(d), "doc_id")
    return ST.voice_match(delta, ST.feature_distance(_features(d), PROFILE, "doc_id"), "doc_id")


def copied_from_benchmark(spark, sf_dir):
    return A.copied_from(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id")


def copied_turns(spark, sf_dir):
    """Turns that share 4-word runs with the turn before, and how many of theirs they share."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.explode(A.word_grams(F.col("text"))).alias("g"))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), "g").distinct()
    hit = t.join(before.withColumn("hit", F.lit(1)), ["conv_id", "turn", "g"], "left")
    return hit.groupBy("conv_id", "turn").agg(F.count("*").alias("n_grams"), F.count("hit").alias("copied"))


def cloze_grades(spark, sf_dir):
    return X.ANSWERS.df(spark, sf_dir).select("qid", F.coalesce(C.cloze_correct(F.col("answer"), F.col("key")), F.lit(False)).alias("correct"), C.answer_norm(F.col("answer")).alias("norm"))


def open_grades(spark, sf_dir):
    return A.grade_open_approx(X.OPEN_ANSWERS.df(spark, sf_dir))


def articles(spark, sf_dir):
    return X.WORDS_A.df(spark, sf_dir).select("word", C.article_for(F.col("word")).alias("article"))


def issue_ids(spark, sf_dir):
    return X.ISSUES.df(spark, sf_dir).select("doc_id", "rule", "start", "end", C.issue_id(F.col("rule"), F.col("start"), F.col("end")).alias("issue_id"))


def review_schedule(spark, sf_dir):
    cards = R.schedule(X.REVIEWS.df(spark, sf_dir))
    return cards.select("card_id", F.round("ease", 4).alias("ease"), "interval", F.col("reps").cast("long"), F.col("lapses").cast("long"), "due", C.interval_label(F.col("interval") * 1440.0).alias("label"))


def event_schedule(spark, sf_dir):
    """SM-2 over the event log: a user is a card, the minute of the day count is the time, the event id gives the grade."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    log = e.select(F.col("user_id").alias("card_id"), F.col("event_id").cast("double").alias("at_min"), (F.col("event_id") % 4 + 1).cast("int").alias("grade"))
    return R.schedule(log).select("card_id", F.round("ease", 4).alias("ease"), F.col("reps").cast("long"), F.col("lapses").cast("long"))


def review_streaks(spark, sf_dir):
    runs = R.streaks(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return runs.select("user_id", F.col("first_day").cast("string"), F.col("last_day").cast("string"), "days")


def ownership(spark, sf_dir):
    return O.ownership(X.PROGRESS.df(spark, sf_dir), O.origin_counts(X.ORIGINS.df(spark, sf_dir)))


def gates(spark, sf_dir):
    return O.gate(X.PROGRESS.df(spark, sf_dir))


def viva_levels(spark, sf_dir):
    return O.viva_summary(X.VIVA.df(spark, sf_dir)).select("doc_id", F.col("level").cast("long"), "n", "average", "passed")


def concept_lists(spark, sf_dir):
    return O.concept_lists(X.VIVA.df(spark, sf_dir))


def quality_rollup(spark, sf_dir):
    """Sentence statistics of labelled documents by source and in total (grouping sets)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    r = M.rhythm(docs(spark, sf_dir)).join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id").join(labels, "doc_id")
    return r.rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("length_mean"), 4).alias("length_mean"), F.sum("monotone_runs").alias("runs"), F.round(F.avg(F.col("quality").cast("double")), 4).alias("quality"))


QUERIES = {f.__name__: f for f in (
    protected_spans, protected_merged, span_merge, span_priority, span_joins, edits_applied, offsets_mapped, ngram_counts, fluency_fixture, fluency, function_word_rates, style_reference, style_delta, style_reference_corpus, style_delta_corpus,
    style_distance, style_differences, voice_match, copied_from_benchmark, copied_turns, cloze_grades, open_grades, articles, issue_ids, review_schedule, event_schedule, review_streaks, ownership, gates,
    viva_levels, concept_lists, quality_rollup,
)}


def _lm(corpus: str, texts: str, cols: str = "id") -> str:
    tok = lambda t: rf"list_concat(['<s>', '<s>'], list_concat(list_transform(regexp_extract_all(lower({t}), '[a-z]+(?:''[a-z]+)?|[0-9]+(?:[.,][0-9]+)*|[^\sa-z0-9]'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '<num>' ELSE x END), ['</s>']))"
    return f"""
c AS (SELECT {tok('text')} AS t FROM {corpus}), ci AS (SELECT t, unnest(range(3, len(t) + 1)) AS i FROM c),
u AS (SELECT t[i] AS g, count(*) AS n FROM ci GROUP BY 1), b AS (SELECT t[i-1] || ' ' || t[i] AS g, count(*) AS n FROM ci GROUP BY 1), tr AS (SELECT t[i-2] || ' ' || t[i-1] || ' ' || t[i] AS g, count(*) AS n FROM ci GROUP BY 1),
z AS (SELECT sum(n) AS total, count(*) AS types FROM u),
q AS (SELECT id, {tok('text')} AS t FROM {texts}), qi AS (SELECT id, t, unnest(range(3, len(t) + 1)) AS i FROM q),
pr AS (SELECT id, log10((coalesce(u.n, 0) + 1.0::DOUBLE) / (total + types)) AS uni,
  CASE WHEN t3.n IS NOT NULL AND m2.n IS NOT NULL THEN log10(t3.n::DOUBLE / m2.n) WHEN t2.n IS NOT NULL AND m1.n IS NOT NULL THEN log10(0.4::DOUBLE) + log10(t2.n::DOUBLE / m1.n)
  ELSE 2 * log10(0.4::DOUBLE) + log10((coalesce(u.n, 0) + 1.0::DOUBLE) / (total + types)) END AS p
  FROM qi CROSS JOIN z LEFT JOIN u ON u.g = t[i] LEFT JOIN b t2 ON t2.g = t[i-1] || ' ' || t[i] LEFT JOIN tr t3 ON t3.g = t[i-2] || ' ' || t[i-1] || ' ' || t[i]
  LEFT JOIN b m2 ON m2.g = t[i-2] || ' ' || t[i-1] LEFT JOIN u m1 ON m1.g = t[i-1])
SELECT id, count(*) AS n_tokens, round(avg(p), 6) AS logprob, round(avg(p - uni), 6) AS slor FROM pr GROUP BY id"""


_ENGLISH = "(SELECT * FROM documents WHERE lang = 'en' AND length(text) > 0)"
_FW = "[" + ", ".join(f"'{w}'" for w in ST.FUNCTION_WORDS) + "]"


def _rates(by: str, where: str = "") -> str:
    return f"""lw AS (SELECT d.{by}, list_transform(w.w, lambda x: lower(x)) AS l, d.doc_id AS did FROM documents d JOIN w ON w.doc_id = d.doc_id {where}),
sz AS (SELECT {by}, sum(len(l))::BIGINT AS n_words FROM lw GROUP BY 1), ex AS (SELECT {by}, unnest(l) AS word FROM lw), ct AS (SELECT {by}, word, count(*) AS n FROM ex GROUP BY 1, 2),
rt AS (SELECT sz.{by}, f.word, n_words, 1000.0::DOUBLE * coalesce(n, 0) / greatest(n_words, 1) AS rate FROM sz CROSS JOIN (SELECT unnest({_FW}) AS word) f LEFT JOIN ct ON ct.{by} = sz.{by} AND ct.word = f.word)"""


_REF = f"""en AS (SELECT w.doc_id, list_transform(w.w, lambda x: lower(x)) AS l FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE d.lang = 'en'),
ei AS (SELECT doc_id, unnest(l) AS word, (generate_subscripts(l, 1) - 1) // 200 AS part FROM en), fu AS (SELECT doc_id, part FROM ei GROUP BY 1, 2 HAVING count(*) = 200), kk AS (SELECT count(*) AS k FROM fu),
hc AS (SELECT doc_id, part, word, 5.0::DOUBLE * count(*) AS r FROM ei SEMI JOIN fu USING (doc_id, part) WHERE list_contains({_FW}, word) GROUP BY 1, 2, 3),
rf AS (SELECT word, sum(r) / k AS mean, greatest(0.5::DOUBLE, sqrt(greatest(0.0::DOUBLE, sum(r * r) / k - (sum(r) / k) * (sum(r) / k)))) AS sd FROM hc CROSS JOIN kk GROUP BY word, k)"""
_CORPUS_REF = f"""en AS (SELECT w.doc_id, list_transform(w.w, lambda x: lower(x)) AS l FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE d.lang = 'en'),
ei AS (SELECT word, (row_number() OVER (ORDER BY doc_id, i) - 1) // 1000 AS part FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM en)), kk AS (SELECT count(*) // 1000 AS k FROM ei),
hc AS (SELECT part, word, count(*)::DOUBLE AS r FROM ei CROSS JOIN kk WHERE part < k AND list_contains({_FW}, word) GROUP BY 1, 2),
sm AS (SELECT f.word, coalesce(sum(r), 0.0::DOUBLE) AS s, coalesce(sum(r * r), 0.0::DOUBLE) AS q FROM (SELECT unnest({_FW}) AS word) f LEFT JOIN hc ON hc.word = f.word GROUP BY 1),
rf AS (SELECT word, s / greatest(k, 1) AS mean, greatest(0.5::DOUBLE, sqrt(greatest(0.0::DOUBLE, q / greatest(k, 1) - (s / greatest(k, 1)) * (s / greatest(k, 1))))) AS sd FROM sm CROSS JOIN kk)"""
_DELTA = "avg(abs((rt.n_words::DOUBLE / (rt.n_words + 250) * rt.rate + (1 - rt.n_words::DOUBLE / (rt.n_words + 250)) * mean - mean) / sd - (p.rate - mean) / sd))"
_FEAT = f"""{SENTENCES}, {WORDS},
st AS (SELECT doc_id, count(*) AS m, avg(len(words)) AS lm, stddev_pop(len(words)) AS sd FROM sents GROUP BY 1),
ft AS (SELECT d.doc_id, coalesce(lm, 0.0::DOUBLE) AS sentence_length_mean, CASE WHEN coalesce(m, 0) < 2 THEN 8.0::DOUBLE ELSE sd END AS sentence_length_sd,
  CASE WHEN len(w.w) > 0 THEN list_sum(list_transform(w.w, lambda x: length(x)))::DOUBLE / len(w.w) ELSE 0.0::DOUBLE END AS word_length_mean,
  CASE WHEN m > 0 THEN len(regexp_extract_all(d.text, ','))::DOUBLE / m ELSE 0.0::DOUBLE END AS commas_per_sentence, d.lang FROM documents d JOIN w USING (doc_id) LEFT JOIN st USING (doc_id))"""
_Z = {k: f"(({k} - {PROFILE[k]!r}::DOUBLE) / {s!r}::DOUBLE)" for k, s in ST.FEATURE_SCALE.items() if k in PROFILE}
_RMS = "sqrt((" + " + ".join(f"{z} * {z}" for z in _Z.values()) + ") / 4)"
_GRAMS = r"list_transform(range(1, greatest(len({w}) - 2, 1)), lambda i: array_to_string({w}[i:i+3], ' '))"


def _gram_table(name: str, table: str, cols: str) -> str:
    return rf"{name}w AS (SELECT {cols}, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM {table}), {name} AS (SELECT {cols}, unnest(CASE WHEN len(w) >= 4 THEN {_GRAMS.format(w='w')} ELSE [] END) AS g FROM {name}w)"


def _find_sql() -> str:
    out = []
    for kind, p in PATTERNS.items():
        q = p.replace("'", "''")
        out.append(rf"""SELECT doc_id, '{kind}' AS kind, unnest(g) AS gap, unnest(m) AS surface, generate_subscripts(m, 1) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{q}') AS m, regexp_split_to_array(text, '{q}')[1:len(regexp_extract_all(text, '{q}'))] AS g FROM documents) WHERE len(m) > 0""")
    return (
        "parts AS (" + " UNION ALL ".join(out) + """), spans AS (SELECT doc_id, kind, (sum(length(gap) + length(surface)) OVER (PARTITION BY doc_id, kind ORDER BY k))::BIGINT AS "end", surface FROM parts),
found AS (SELECT doc_id, kind, "end" - length(surface) AS start, "end", surface FROM spans)"""
    )


def _islands_sql(table: str, strict: str, kinds: list[str] | None) -> str:
    rank = f", list_position([{', '.join(repr(k) for k in kinds)}], kind) AS rk" if kinds else ""
    pick = ", arg_min(kind, rk) AS kind" if kinds else ""
    return f"""
a AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach{rank} FROM {table}),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR start {strict} reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM a)
SELECT doc_id, min(start) AS start, max("end") AS "end"{pick} FROM b GROUP BY doc_id, island"""


_SM2 = """
lg AS (SELECT card_id, list({{'t': at_min, 'g': grade}} ORDER BY at_min, grade) AS l FROM {log} GROUP BY card_id),
fd AS (SELECT card_id, list_reduce(list_prepend({{'e': 2.5::DOUBLE, 'i': 0.0::DOUBLE, 'r': 0::BIGINT, 'x': 0::BIGINT, 'd': 0.0::DOUBLE, 'g': 0::INTEGER, 't': 0.0::DOUBLE}},
    list_transform(l, lambda v: {{'e': 0.0::DOUBLE, 'i': 0.0::DOUBLE, 'r': 0::BIGINT, 'x': 0::BIGINT, 'd': 0.0::DOUBLE, 'g': v.g::INTEGER, 't': v.t::DOUBLE}})),
  lambda a, v: {{'e': greatest(1.3::DOUBLE, a.e + (0.1::DOUBLE - (5 - CASE v.g WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * (0.08::DOUBLE + (5 - CASE v.g WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * 0.02::DOUBLE))),
    'i': CASE WHEN v.g = 1 THEN 0.0::DOUBLE WHEN a.r = 0 THEN 1.0::DOUBLE WHEN a.r = 1 THEN 6.0::DOUBLE ELSE floor(a.i * greatest(1.3::DOUBLE, a.e + (0.1::DOUBLE - (5 - CASE v.g WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * (0.08::DOUBLE + (5 - CASE v.g WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * 0.02::DOUBLE))) + 0.5::DOUBLE) END,
    'r': CASE WHEN v.g = 1 THEN 0::BIGINT ELSE a.r + 1 END, 'x': a.x + CASE WHEN v.g = 1 THEN 1 ELSE 0 END,
    'd': v.t + CASE WHEN v.g = 1 THEN 10.0::DOUBLE WHEN a.r = 0 THEN 1440.0::DOUBLE WHEN a.r = 1 THEN 8640.0::DOUBLE ELSE 1440.0::DOUBLE * floor(a.i * greatest(1.3::DOUBLE, a.e + (0.1::DOUBLE - (5 - CASE v.g WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * (0.08::DOUBLE + (5 - CASE v.g WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 5 END) * 0.02::DOUBLE))) + 0.5::DOUBLE) END,
    'g': v.g, 't': v.t}}) AS f FROM lg)"""
_NORM = r"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_\s-]', ' ', 'g'), '\s+', ' ', 'g'), ' '), '^(?:the|a|an)\s+', ''), ' ')"

ORACLES = {
    "protected_spans": f"WITH {_find_sql()} SELECT * FROM found",
    "protected_merged": f"WITH {_find_sql()}, {_islands_sql('found', '>=', list(PATTERNS)).strip()}",
    "span_merge": f"WITH {X.SPANS.cte()}, {_islands_sql('fx_spans', '>', None).strip()}",
    "span_priority": f"WITH {X.SPANS.cte()}, n AS (SELECT * FROM fx_spans WHERE start < \"end\"), {_islands_sql('n', '>=', PRIORITY).strip()}",
    "span_joins": f"""WITH {X.SPANS.cte()}, {X.WINDOWS.cte()}, mg AS (WITH {_islands_sql('fx_windows', '>', None).strip()})
SELECT doc_id, start, "end", kind, 'overlap' AS op FROM fx_spans s WHERE EXISTS (SELECT 1 FROM fx_windows w WHERE w.doc_id = s.doc_id AND s.start < w."end" AND w.start < s."end")
UNION ALL SELECT doc_id, start, "end", kind, 'anti' FROM fx_spans s WHERE NOT EXISTS (SELECT 1 FROM fx_windows w WHERE w.doc_id = s.doc_id AND s.start < w."end" AND w.start < s."end")
UNION ALL SELECT doc_id, start, "end", kind, 'covered' FROM fx_spans s WHERE EXISTS (SELECT 1 FROM mg w WHERE w.doc_id = s.doc_id AND w.start <= s.start AND s."end" <= w."end")
UNION ALL SELECT s.doc_id, greatest(s.start, w.start), least(s."end", w."end"), window_id::VARCHAR, 'clip' FROM fx_spans s JOIN fx_windows w ON w.doc_id = s.doc_id AND s.start < w."end" AND w.start < s."end" """,
    "edits_applied": f"""WITH {X.EDIT_DOCS.cte()}, {X.EDITS.cte()}, e AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start, "end"), 0) AS prev FROM fx_edits),
j AS (SELECT doc_id, string_agg(substr(text, (prev + 1)::BIGINT, greatest(start - prev, 0)::BIGINT) || replacement, '' ORDER BY start, "end") AS head, max("end") AS last, bool_and(start >= prev) AS ok FROM e JOIN fx_edit_docs USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN j.doc_id IS NULL THEN text WHEN ok THEN head || substr(text, last + 1) END AS text FROM fx_edit_docs d LEFT JOIN j ON j.doc_id = d.doc_id""",
    "offsets_mapped": f"""WITH {X.OFFSETS.cte()}, {X.EDITS.cte()}, e AS (SELECT * FROM fx_edits), bad AS (SELECT DISTINCT a.doc_id FROM fx_edits a JOIN fx_edits b ON a.doc_id = b.doc_id AND a.start < b.start AND b.start < a."end")
SELECT o.doc_id, pos, CASE WHEN o.doc_id NOT IN (SELECT doc_id FROM bad) THEN (coalesce(max(CASE WHEN e.start < pos AND pos < e."end" THEN e.start END), pos) + coalesce(sum(CASE WHEN e."end" <= pos THEN length(replacement) - (e."end" - e.start) ELSE 0 END), 0))::BIGINT END AS new_pos
FROM fx_offsets o LEFT JOIN e ON e.doc_id = o.doc_id AND e.start < pos GROUP BY o.doc_id, pos""",
    "ngram_counts": "WITH " + _lm(_ENGLISH, "documents").split("z AS (")[0].strip().rstrip(",") + " SELECT md5(g) AS digest, n FROM tr WHERE n >= 2",
    "fluency_fixture": f"WITH {X.LM_CORPUS.cte()}, {X.LM_TESTS.cte()}, {_lm('fx_lm', 'fx_lm_tests').strip()}",
    "fluency": f"WITH {_lm(_ENGLISH, '(SELECT item_id AS id, text FROM benchmark)').strip()}",
    "function_word_rates": f"WITH {WORDS}, {_rates('source')} SELECT source, word, n_words, round(rate, 4) AS rate FROM rt",
    "style_reference": f"WITH {WORDS}, {_REF} SELECT word, round(mean, 4) AS mean, round(sd, 4) AS sd FROM rf",
    "style_delta": f"WITH {WORDS}, {_rates('source', "WHERE d.lang = 'en'")}, {_REF} SELECT rt.source, round({_DELTA}, 4) AS delta FROM rt JOIN (SELECT * FROM rt WHERE source = 'src1') p ON p.word = rt.word JOIN rf ON rf.word = rt.word GROUP BY rt.source",
    "style_reference_corpus": f"WITH {WORDS}, {_CORPUS_REF} SELECT word, round(mean, 4) AS mean, round(sd, 4) AS sd FROM rf",
    "style_delta_corpus": f"WITH {WORDS}, {_rates('source', "WHERE d.lang = 'en'")}, {_CORPUS_REF} SELECT rt.source, round({_DELTA}, 4) AS delta FROM rt JOIN (SELECT * FROM rt WHERE source = 'src1') p ON p.word = rt.word JOIN rf ON rf.word = rt.word GROUP BY rt.source",
    "style_distance": f"WITH {_FEAT} SELECT doc_id, round({_RMS}, 4) AS rms FROM ft",
    "style_differences": f"WITH {_FEAT}, zz AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS feature, {z} AS z FROM ft" for k, z in _Z.items()) + "), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(z) DESC, feature) AS rank FROM zz WHERE abs(z) >= 0.5) SELECT doc_id, rank, feature, round(z, 4) AS z FROM rk WHERE rank <= 3",
    "copied_from_benchmark": f"WITH {_gram_table('d', 'documents', 'doc_id')}, {_gram_table('b', 'benchmark', 'item_id')}, k AS (SELECT DISTINCT g FROM b) SELECT doc_id, count(*) AS n_grams, count(k.g) AS copied FROM d LEFT JOIN k ON k.g = d.g GROUP BY doc_id",
    "copied_turns": f"WITH {_gram_table('d', 'conversations', 'conv_id, turn')}, k AS (SELECT DISTINCT conv_id, turn + 1 AS turn, g FROM d) SELECT d.conv_id, d.turn, count(*) AS n_grams, count(k.g) AS copied FROM d LEFT JOIN k ON k.conv_id = d.conv_id AND k.turn = d.turn AND k.g = d.g GROUP BY 1, 2",
    "cloze_grades": f"""WITH {X.ANSWERS.cte()}, n AS (SELECT qid, {_NORM.format(x='answer')} AS norm, {_NORM.format(x='key')} AS k FROM fx_answers),
s AS (SELECT *, string_split(norm, ' ') AS a, string_split(k, ' ') AS b FROM n)
SELECT qid, coalesce(norm <> '' AND (norm = k OR (len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = b[i] OR (length(b[i]) > 5 AND levenshtein(a[i], b[i]) <= 2)))) = 0)), false) AS correct, norm FROM s""",
    "open_grades": rf"""WITH {X.OPEN_ANSWERS.cte()}, b AS (SELECT qid, len(list_filter(regexp_split_to_array(trim(answer), '\s+'), lambda x: x <> '')) AS n, ' ' || regexp_replace(lower(answer), '[^a-z0-9]+', ' ', 'g') || ' ' AS low, list_filter(string_split(concepts, '|'), lambda x: x <> '') AS c,
  regexp_extract_all(lower(answer), '[a-z0-9_]+') AS aw, regexp_extract_all(lower(source), '[a-z0-9_]+') AS sw FROM fx_open),
g AS (SELECT *, CASE WHEN len(aw) >= 4 THEN {_GRAMS.format(w='aw')} ELSE [] END AS ag, CASE WHEN len(sw) >= 4 THEN {_GRAMS.format(w='sw')} ELSE [] END AS sg FROM b),
v AS (SELECT qid, n, CASE WHEN len(c) > 0 THEN len(list_filter(c, lambda k: contains(low, ' ' || lower(k) || ' ')))::DOUBLE / len(c) ELSE 0.0::DOUBLE END AS coverage, CASE WHEN len(ag) > 0 THEN len(list_filter(ag, lambda x: list_contains(sg, x)))::DOUBLE / len(ag) ELSE 0.0::DOUBLE END AS share FROM g)
SELECT qid, round(coverage, 4) AS coverage, n >= 8 AND share >= 0.6 AS copied, round(CASE WHEN n < 3 THEN 0.0::DOUBLE WHEN n >= 8 AND share >= 0.6 THEN least(50.0::DOUBLE, 100 * coverage) ELSE 100 * coverage END, 1) AS score FROM v""",
    "articles": f"WITH {X.WORDS_A.cte()} SELECT word, CASE WHEN regexp_matches(lower(word), '^(?:hour|honest|honour|heir)') THEN 'an' WHEN regexp_matches(lower(word), '^(?:uni|use|usu|eu|one|once)') THEN 'a' WHEN regexp_matches(word, '^[A-Z]{{2,}}') THEN CASE WHEN regexp_matches(word, '^[AEFHILMNORSX]') THEN 'an' ELSE 'a' END WHEN regexp_matches(lower(word), '^[aeiou]') THEN 'an' ELSE 'a' END AS article FROM fx_words",
    "issue_ids": f"WITH {X.ISSUES.cte()} SELECT doc_id, rule, start, \"end\", left(sha1(rule || ':' || start || ':' || \"end\"), 10) AS issue_id FROM fx_issues",
    "review_schedule": f"WITH {X.REVIEWS.cte()}, {_SM2.format(log='fx_reviews').strip()} SELECT card_id, round(f.e, 4) AS ease, f.i AS interval, f.r AS reps, f.x AS lapses, f.d AS due, CASE WHEN f.i < 1 THEN '0 min' WHEN f.i < 30 THEN f.i::BIGINT || ' d' WHEN f.i < 365 THEN round(f.i / 30)::BIGINT || ' mo' ELSE round(f.i / 365, 1)::DECIMAL(10, 1) || ' y' END AS label FROM fd",
    "event_schedule": f"WITH ev AS (SELECT user_id AS card_id, event_id::DOUBLE AS at_min, (event_id % 4 + 1)::INTEGER AS grade FROM events), {_SM2.format(log='ev').strip()} SELECT card_id, round(f.e, 4) AS ease, f.r AS reps, f.x AS lapses FROM fd",
    "review_streaks": "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), r AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INTEGER AS run FROM d) SELECT user_id, min(day)::DATE::VARCHAR AS first_day, max(day)::DATE::VARCHAR AS last_day, count(*) AS days FROM r GROUP BY user_id, run",
    "gates": f"WITH {X.PROGRESS.cte()}, g AS (SELECT doc_id, coalesce(quiz >= 70, false) AS quiz_ok, coalesce(teach >= 60, false) AS teach_ok, CASE WHEN paragraphs > 0 THEN 100.0 * marked / paragraphs ELSE 0 END >= 80 AS walkthrough_ok FROM fx_progress) SELECT *, quiz_ok AND teach_ok AND walkthrough_ok AS open FROM g",
    "viva_levels": f"WITH {X.VIVA.cte()}, a AS (SELECT doc_id, level, count(*) AS n, avg(score) AS v FROM fx_viva GROUP BY 1, 2), l AS (SELECT DISTINCT doc_id, unnest([1, 2, 3, 4]) AS level FROM fx_viva) SELECT l.doc_id, l.level::BIGINT AS level, coalesce(n, 0) AS n, round(v, 4) AS average, coalesce(v >= 70, false) AS passed FROM l LEFT JOIN a ON a.doc_id = l.doc_id AND a.level = l.level",
    "concept_lists": f"WITH {X.VIVA.cte()}, w AS (SELECT DISTINCT doc_id, lower(concept) AS concept FROM fx_viva WHERE score < 40), m AS (SELECT DISTINCT doc_id, lower(concept) AS concept FROM fx_viva WHERE score >= 70) SELECT *, 'weak' AS kind FROM w UNION ALL SELECT *, 'mastered' FROM m ANTI JOIN w USING (doc_id, concept)",
    "ownership": f"""WITH {X.ORIGINS.cte()}, {X.PROGRESS.cte()},
o AS (SELECT doc_id, sum(CASE WHEN origin IN ('student_edit', 'student_insert') THEN n ELSE 0 END)::DOUBLE AS own, sum(n) AS size FROM (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM fx_origins) GROUP BY doc_id),
p AS (SELECT f.doc_id, coalesce(CASE WHEN size > 0 THEN own / size END, 0.0::DOUBLE) AS authorship, CASE WHEN offered > 0 THEN least(1.0::DOUBLE, decided::DOUBLE / offered) END AS decisions, CASE WHEN spots > 0 THEN filled::DOUBLE / spots END AS personalization,
  (CASE WHEN paragraphs > 0 THEN got::DOUBLE / paragraphs ELSE 0.0::DOUBLE END + coalesce(quiz, 0.0::DOUBLE) / 100.0::DOUBLE + coalesce(teach, 0.0::DOUBLE) / 100.0::DOUBLE) / 3 AS understanding FROM fx_progress f LEFT JOIN o ON o.doc_id = f.doc_id),
w AS (SELECT *, 0.65::DOUBLE + (decisions IS NOT NULL)::INTEGER * 0.2::DOUBLE + (personalization IS NOT NULL)::INTEGER * 0.15::DOUBLE AS wt FROM p)
SELECT doc_id, round(authorship, 4) AS authorship, round(decisions, 4) AS decisions, round(understanding, 4) AS understanding, round(personalization, 4) AS personalization,
  round(100.0::DOUBLE * authorship * 0.45::DOUBLE / wt, 4) AS points_authorship, round(100.0::DOUBLE * decisions * 0.2::DOUBLE / wt, 4) AS points_decisions, round(100.0::DOUBLE * understanding * 0.2::DOUBLE / wt, 4) AS points_understanding, round(100.0::DOUBLE * personalization * 0.15::DOUBLE / wt, 4) AS points_personalization,
  round(100.0::DOUBLE * (authorship * 0.45::DOUBLE + coalesce(decisions, 0) * 0.2::DOUBLE + understanding * 0.2::DOUBLE + coalesce(personalization, 0) * 0.15::DOUBLE) / wt)::BIGINT AS ownership FROM w""",
    "quality_rollup": f"""WITH {SENTENCES}, {RUNS.strip()}, st AS (SELECT doc_id, avg(len(words)) AS lm FROM sents GROUP BY 1)
SELECT source, count(*) AS n, round(avg(coalesce(lm, 0.0::DOUBLE)), 4) AS length_mean, sum(coalesce(monotone_runs, 0))::BIGINT AS runs, round(avg(quality::DOUBLE), 4) AS quality FROM documents JOIN labels USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN runs USING (doc_id) GROUP BY ROLLUP (source)""",
}
