"""Document metrics: rhythm, vocabulary, clarity, voice; banded scores and their weighted means.

All metrics of a document come from its own row, by folds over its sentences or words, so a corpus is scored without a shuffle.
Only MTLD runs in Python (Arrow batches): its fold keeps a set, which column expressions cannot do in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.scalars import band_score
from ..functions.text import let, match_count, sentence_array, word_list
from .issues import LEXICONS, QUIET, SCORED, STACK_WORDS, STACKED, WEAK_VERB, alternation

#: Good bands as (metric, score) points, and weights of metrics and of sub-scores.
BANDS = {
    "rhythm": {
        "sentence_length_sd": (0.45, [(0, 0), (2, 15), (4, 45), (6, 80), (8, 100), (14, 100), (18, 80), (25, 50)]),
        "opener_entropy": (0.35, [(0, 0), (0.5, 30), (0.7, 65), (0.85, 95), (1, 100)]),
        "monotone_runs_per_10s": (0.2, [(0, 100), (0.5, 85), (1, 65), (2, 35), (4, 0)]),
    },
    "vocabulary": {
        "mtld": (0.3, [(0, 0), (30, 20), (50, 50), (70, 80), (90, 100)]),
        "repeats_per_100w": (0.2, [(0, 100), (1, 90), (2, 70), (4, 40), (7, 0)]),
        "stock_per_100w": (0.35, [(0, 100), (0.5, 80), (1, 60), (2, 30), (3, 0)]),
        "cliche_per_100w": (0.15, [(0, 100), (0.3, 80), (0.7, 55), (1.5, 20), (2.5, 0)]),
    },
    "clarity": {
        "grade_excess": (0.35, [(0, 100), (2, 85), (4, 65), (6, 45), (9, 15), (12, 0)]),
        "long_sentence_pct": (0.25, [(0, 100), (10, 85), (20, 65), (35, 35), (60, 0)]),
        "nominalizations_per_100w": (0.2, [(0, 100), (3, 95), (5, 80), (8, 50), (12, 20), (16, 0)]),
        "wordy_per_100w": (0.2, [(0, 100), (0.5, 90), (1, 75), (2, 50), (4, 10), (5, 0)]),
    },
    "voice": {
        "passive_ratio": (0.3, [(0, 100), (0.15, 95), (0.25, 80), (0.4, 55), (0.6, 25), (0.8, 0)]),
        "hedges_per_100w": (0.2, [(0, 100), (1, 90), (2, 70), (4, 35), (6, 0)]),
        "fillers_per_100w": (0.25, [(0, 100), (0.5, 90), (1, 75), (2, 45), (4, 0)]),
        "weak_verbs_per_100w": (0.25, [(0, 100), (0.5, 85), (1, 65), (2, 35), (3, 0)]),
    },
}
WEIGHTS = {"clarity": 0.25, "rhythm": 0.2, "vocabulary": 0.2, "voice": 0.2, "correctness": 0.15}
TARGET_GRADE = 12
NOMINAL = r"(?:tion|sion|ment|ance|ence)s?$"
#: Forms of be, and the endings by which a participle is told without a parse.
PASSIVE = r"(?i)(?:^|[^a-z])(?:is|are|was|were|be|been|being)\s+(?:[a-z]+ly\s+)?[a-z]+(?:ed|en|wn|lt|ught)(?:[^a-z]|$)"
EXPLETIVE = r"(?i)^\W*there\s+(?:is|are|was|were)\s.*[^a-z](?:that|who|which)(?:[^a-z]|$)"
MTLD_THRESHOLD = 0.72


def total(array: Column, of=lambda x: x) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + of(x))


def spread(values: Column) -> Column:
    """Population standard deviation of an array, by running means (Welford): a difference of large squares loses digits, and grades at a rounding point with them."""
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a, x):
        mean = a["mean"] + (x - a["mean"]) / (a["k"] + 1)
        return let(mean, lambda m: F.struct((a["k"] + 1).alias("k"), m.alias("mean"), (a["m2"] + (x - a["mean"]) * (x - m)).alias("m2")))

    return F.aggregate(values, start, step, lambda a: F.when(a["k"] > 0, F.sqrt(a["m2"] / a["k"])))


def monotone_runs(sents: Column) -> Column:
    """Maximal runs of three or more sentences of one paragraph (para_idx, n), all pairs of similar length.

    Similarity to every member is similarity to the shortest and the longest, so the fold keeps those two.
    """
    start = F.struct(F.lit(-1).cast("long").alias("para"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0).alias("len"), F.lit(0).alias("runs"))

    def step(a, x):
        low, high = F.least(a["low"], x["n"]), F.greatest(a["high"], x["n"])
        goes_on = (a["para"] == x["para_idx"]) & (high - low <= F.greatest(F.lit(2.0), high * 0.15))
        done = a["runs"] + (a["len"] >= 3).cast("int")
        return F.struct(
            x["para_idx"].alias("para"),
            F.when(goes_on, low).otherwise(x["n"]).alias("low"),
            F.when(goes_on, high).otherwise(x["n"]).alias("high"),
            F.when(goes_on, a["len"] + 1).otherwise(1).alias("len"),
            F.when(goes_on, a["runs"]).otherwise(done).alias("runs"),
        )

    return F.aggregate(sents, start, step, lambda a: (a["runs"] + (a["len"] >= 3).cast("int")).cast("long"))


def entropy(keys: Column) -> Column:
    """Natural-log entropy of the values of an array over the log of its size; 1 below two values."""

    def folded(s: Column) -> Column:
        n = F.size(s)
        start = F.struct(F.lit("").alias("key"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
        add = lambda a: a["sum"] + F.when(a["run"] > 1, a["run"] * F.log(a["run"].cast("double"))).otherwise(0.0)
        step = lambda a, x: F.struct(
            x.alias("key"), F.when(x == a["key"], a["run"] + 1).otherwise(1).alias("run"), F.when(x == a["key"], a["sum"]).otherwise(add(a)).alias("sum")
        )
        return F.when(n < 2, F.lit(1.0)).otherwise((F.log(n.cast("double")) - F.aggregate(s, start, step, add) / n) / F.log(n.cast("double")))

    return let(F.array_sort(keys), folded)


def measured_sentences(text: Column) -> Column:
    """(para_idx, n words, first word lower-cased) of each sentence."""
    return F.transform(
        sentence_array(text),
        lambda s: let(
            word_list(s["sentence"]), lambda w: F.struct(s["para_idx"].alias("para_idx"), F.size(w).cast("long").alias("n"), F.lower(w[0]).alias("first"))
        ),
    )


def rhythm_of(text: Column) -> Column:
    """A struct: n_sents, length_mean, sentence_length_sd, opener_entropy, monotone_runs, monotone_runs_per_10s."""

    def all_of(s: Column) -> Column:
        n = F.size(s).cast("long")
        mean = total(s, lambda x: x["n"]) / n
        runs = monotone_runs(s)
        return F.struct(
            n.alias("n_sents"),
            F.when(n > 0, mean).otherwise(0.0).alias("length_mean"),
            F.when(n < 2, 8.0).otherwise(spread(F.transform(s, lambda x: x["n"].cast("double")))).alias("sentence_length_sd"),
            F.when(n < 3, 1.0).otherwise(entropy(F.transform(s, lambda x: x["first"]))).alias("opener_entropy"),
            runs.alias("monotone_runs"),
            F.when(n > 0, runs * 10.0 / n).otherwise(0.0).alias("monotone_runs_per_10s"),
        )

    return let(measured_sentences(text), all_of)


def rhythm(docs: DataFrame) -> DataFrame:
    """doc_id and what rhythm_of() gives."""
    return docs.select("doc_id", rhythm_of(F.col("text")).alias("r")).select("doc_id", "r.*")


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits, halves away from 0 once scaled: a half that a sum missed by its last bit counts as one (F.round goes by the shortest decimal)."""
    return F.round(x * 10.0**digits) / 10.0**digits


def sub_score(name: str) -> Column:
    """Weighted mean of the band scores of a sub-score's metrics; null metrics drop out."""
    score, weight = F.lit(0.0), F.lit(0.0)
    for metric, (w, points) in BANDS[name].items():
        there = F.col(metric).isNotNull()
        score += F.when(there, band_score(F.col(metric), points) * w).otherwise(0.0)
        weight += F.when(there, F.lit(w)).otherwise(0.0)
    return F.when(weight > 0, rounded(score / weight, 1))


def overall_score(scores: list[str]) -> Column:
    """Weighted mean of the sub-scores that are not null."""
    top = sum((F.coalesce(F.col(s) * WEIGHTS[s], F.lit(0.0)) for s in scores), F.lit(0.0))
    weight = sum((F.when(F.col(s).isNotNull(), WEIGHTS[s]).otherwise(0.0) for s in scores), F.lit(0.0))
    return F.when(weight > 0, rounded(top / weight, 1))


def mtld_one_way(words: list[str]) -> float:
    """Words per stretch over which the share of different words falls to the threshold.

    The stretch left open at the end counts as the part of the way that its share has fallen. A word is new to a stretch
    if it was last met before the stretch began.
    """
    met: dict[str, int] = {}
    begin = different = stretches = 0
    for place, word in enumerate(words):
        different += met.get(word, -1) < begin
        met[word] = place
        if different / (place + 1 - begin) <= MTLD_THRESHOLD:
            begin, different, stretches = place + 1, 0, stretches + 1
    left = len(words) - begin
    fallen = (1 - different / left) / (1 - MTLD_THRESHOLD) if left else 0.0
    return len(words) / (stretches + fallen) if stretches + fallen else float(len(words))


@F.pandas_udf(DoubleType())
def mtld(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Lexical diversity of an array of words: mean of a forward and a backward pass; 0 under ten words."""
    for words in batches:
        yield words.map(lambda w: 0.0 if w is None or len(w) < 10 else (mtld_one_way(list(w)) + mtld_one_way(list(w)[::-1])) / 2).astype(float)


def vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_types, mtld."""
    lower = F.transform(word_list(F.coalesce("text", F.lit(""))), F.lower)
    rows = docs.select("doc_id", lower.alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_types"), mtld("w").alias("mtld"))


def syllables(word: Column) -> Column:
    """Vowel groups, at least one."""
    return F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.lower(word), F.lit("[aeiouy]+"), F.lit(0))))


def clarity_of(text: Column) -> Column:
    """A struct: n_words, n_sents, long_sentence_pct, nominalizations_per_100w, fk_grade_approx, grade_excess."""
    t = F.coalesce(text, F.lit(""))

    def all_of(x: Column) -> Column:
        n, m = F.size(x["w"]).cast("long"), F.size(x["s"]).cast("long")
        long_ = F.size(F.filter(x["s"], lambda y: y["n"] > 30))
        nominal = F.size(F.filter(x["w"], lambda y: (F.length(y) > 6) & F.lower(y).rlike(NOMINAL)))
        grade = F.lit(0.39) * n / m + F.lit(11.8) * total(x["w"], syllables) / n - F.lit(15.59)
        return let(F.when(m > 0, grade), lambda g: F.struct(
            n.alias("n_words"),
            m.alias("n_sents"),
            F.when(m > 0, 100.0 * long_ / m).otherwise(0.0).alias("long_sentence_pct"),
            (100.0 * nominal / F.greatest(n, F.lit(1))).alias("nominalizations_per_100w"),
            g.alias("fk_grade_approx"),
            F.greatest(F.lit(0.0), g - TARGET_GRADE).alias("grade_excess"),
        ))

    return let(F.struct(word_list(t).alias("w"), measured_sentences(t).alias("s")), all_of)


def clarity(docs: DataFrame) -> DataFrame:
    """doc_id and what clarity_of() gives."""
    return docs.select("doc_id", clarity_of(F.col("text")).alias("c")).select("doc_id", "c.*")


def passive_ratio(text: Column) -> Column:
    """Share of sentences with a be-form and a participle-like word."""
    hit = lambda x: F.size(F.filter(x, lambda y: y["sentence"].rlike(PASSIVE)))
    return let(sentence_array(text), lambda x: F.when(F.size(x) > 0, hit(x) / F.size(x).cast("double")).otherwise(0.0))


def voice(docs: DataFrame) -> DataFrame:
    """doc_id, passive_ratio."""
    return docs.select("doc_id", passive_ratio(F.col("text")).alias("passive_ratio"))


def punctuation_rates(docs: DataFrame) -> DataFrame:
    """doc_id and stylometric rates of marks, contractions and the first person."""
    t = F.coalesce(F.col("text"), F.lit(""))
    w = F.transform(word_list(t), F.lower)
    first = F.size(F.filter(w, lambda x: x.isin("i", "me", "my", "mine", "we", "us", "our", "ours", "myself", "ourselves")))
    rows = docs.select("doc_id", t.alias("t"), F.size(sentence_array(t)).cast("long").alias("n_sents"), F.size(w).cast("long").alias("n_words"), first.alias("first"), total(w, F.length).alias("letters"))
    per = lambda c: F.when(F.col("n_sents") > 0, c / F.col("n_sents").cast("double")).otherwise(0.0)
    return rows.select(
        "doc_id", "n_sents", "n_words",
        per(match_count(F.col("t"), ",")).alias("commas_per_sentence"),
        per(match_count(F.col("t"), ";")).alias("semicolons_per_sentence"),
        per(match_count(F.col("t"), r"\(")).alias("parentheses_per_sentence"),
        per(match_count(F.col("t"), r"\?")).alias("questions_per_sentence"),
        per(match_count(F.col("t"), r"(?i)\b\w+(?:n't|'re|'ve|'ll|'d|'m|'s)\b")).alias("contractions_per_sentence"),
        F.when(F.col("n_words") > 0, F.col("letters") / F.col("n_words")).otherwise(0.0).alias("word_length_mean"),
        (1000.0 * F.col("first") / F.greatest(F.col("n_words"), F.lit(1))).alias("first_person_per_1000"),
    )


def hits(sents: Column, pattern: str) -> Column:
    """How many matches the sentences hold; of a lexicon's alternation, as lexicon_hits counts them."""
    return total(sents, lambda x: F.size(F.regexp_extract_all(x["sentence"], F.lit(pattern), F.lit(1))))


def stacked_hedges(words: Column) -> Column:
    """How many of the hedges that count only when stacked have a hedge at most six words before them."""
    near = lambda i: F.slice(words, F.greatest(F.lit(1), i - STACK_WORDS), F.least(i, F.lit(STACK_WORDS + 1)))
    return F.size(F.filter(words, lambda x, i: x.isin(*STACKED) & (i > 0) & F.exists(near(i), lambda y: y.isin(*LEXICONS["hedge"]))))


def near_repeat_count(sents: Column) -> Column:
    """How many words of a sentence, quiet ones aside, one of the two before it in its paragraph has too; as near_repeats."""
    bags = F.transform(sents, lambda x: F.struct(x["para_idx"].alias("para"), F.array_distinct(F.filter(x["w"], lambda w: (F.length(w) >= 4) & ~w.isin(*QUIET))).alias("b")))

    def folded(b: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            y = F.get(b, i)
            return F.when(y["para"] == x["para"], y["b"]).otherwise(F.array().cast("array<string>"))

        return total(F.transform(b, lambda x, i: F.size(F.array_intersect(x["b"], F.concat(before(x, i - 1), before(x, i - 2))))))

    return let(bags, folded)


def rates_of(text: Column) -> Column:
    """A struct: repeats, stock phrases, cliches, wordy phrases, hedges, fillers and weak verbs per 100 words.

    The counts are those of issues.near_repeats and issues.lexicon_hits.
    """
    s = F.transform(sentence_array(text), lambda x: F.struct(x["para_idx"].alias("para_idx"), x["sentence"].alias("sentence"), F.transform(word_list(x["sentence"]), F.lower).alias("w")))

    def all_of(x: Column) -> Column:
        per = lambda c: 100.0 * c / F.greatest(total(x, lambda y: F.size(y["w"])), F.lit(1.0))
        hedges = hits(x, alternation(set(LEXICONS["hedge"]) - STACKED)) + total(x, lambda y: stacked_hedges(y["w"]))
        expletives = total(x, lambda y: ((F.size(y["w"]) > 3) & y["sentence"].rlike(EXPLETIVE)).cast("int"))
        return F.struct(
            per(near_repeat_count(x)).alias("repeats_per_100w"),
            per(hits(x, alternation(SCORED["stock_phrase"]))).alias("stock_per_100w"),
            per(hits(x, alternation(LEXICONS["cliche"]))).alias("cliche_per_100w"),
            per(hits(x, alternation(LEXICONS["wordy_phrase"]))).alias("wordy_per_100w"),
            per(hedges).alias("hedges_per_100w"),
            per(hits(x, alternation(LEXICONS["filler"]))).alias("fillers_per_100w"),
            per(hits(x, WEAK_VERB) + expletives).alias("weak_verbs_per_100w"),
        )

    return let(s, all_of)


def issue_rates(docs: DataFrame) -> DataFrame:
    """doc_id and what rates_of() gives."""
    return docs.select("doc_id", rates_of(F.col("text")).alias("r")).select("doc_id", "r.*")


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, clarity, rhythm, vocabulary, voice, correctness (never available here), overall: a row per row, in one projection."""
    t = F.col("text")
    words = F.transform(word_list(F.coalesce(t, F.lit(""))), F.lower)
    rows = docs.select("doc_id", rhythm_of(t).alias("r"), clarity_of(t).alias("c"), rates_of(t).alias("i"), passive_ratio(t).alias("passive_ratio"), mtld(words).alias("mtld"))
    names = [(k, m) for k, of in (("r", ("sentence_length_sd", "opener_entropy", "monotone_runs_per_10s")), ("c", ("n_words", "n_sents", "long_sentence_pct", "nominalizations_per_100w", "grade_excess"))) for m in of]
    rows = rows.select("doc_id", "passive_ratio", "mtld", "i.*", *[F.col(f"{k}.{m}").alias(m) for k, m in names])
    rows = rows.select(
        "doc_id",
        F.when(F.col("n_sents") > 0, sub_score("rhythm")).alias("rhythm"),
        F.when(F.col("n_words") > 0, sub_score("vocabulary")).alias("vocabulary"),
        F.when(F.col("n_sents") > 0, sub_score("clarity")).alias("clarity"),
        sub_score("voice").alias("voice"),
        F.lit(None).cast("double").alias("correctness"),
    )
    return rows.select("doc_id", "rhythm", "vocabulary", "clarity", "voice", "correctness", overall_score(["clarity", "rhythm", "vocabulary", "voice", "correctness"]).alias("overall"))
