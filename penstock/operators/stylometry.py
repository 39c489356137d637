"""Style profiles: function-word rates, reference statistics, Burrows' Delta, feature distance, voice match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import unit
from ..functions.text import word_list

#: Our own list of English function words.
FUNCTION_WORDS = "the of and to in a is that for it was on with as by at from this be are or an but not have which were".split()
#: Where distances begin and end to count, words of prior weight, typical spread of features between writers.
DELTA_RANGE, FEATURE_RANGE, PRIOR_WORDS = (0.35, 1.6), (0.4, 2.2), 250
FEATURE_SCALE = {
    "sentence_length_mean": 5.0,
    "sentence_length_sd": 4.0,
    "word_length_mean": 0.35,
    "mtld": 25.0,
    "commas_per_sentence": 0.7,
    "semicolons_per_sentence": 0.15,
    "parentheses_per_sentence": 0.25,
    "questions_per_sentence": 0.1,
    "contractions_per_sentence": 0.3,
    "passive_ratio": 0.2,
    "first_person_per_1000": 15.0,
}


def word_counts(docs: DataFrame, by: str) -> DataFrame:
    """by, word, n for function words, and total words of each group in `n_words`."""
    rows = docs.select(by, F.transform(word_list(F.coalesce("text", F.lit(""))), F.lower).alias("w"))
    listed = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    size = rows.groupBy(by).agg(F.sum(F.size("w")).alias("n_words"))
    counts = rows.select(by, F.explode(F.filter("w", lambda x: F.array_contains(listed, x))).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))
    every = size.withColumn("word", F.explode(listed))
    found = counts.select(F.col(by).alias("_by"), F.col("word").alias("_word"), "n")
    # Null-safe: rows without an id are a group too.
    return every.join(found, every[by].eqNullSafe(F.col("_by")) & (F.col("word") == F.col("_word")), "left").select(by, "n_words", "word", F.coalesce("n", F.lit(0)).alias("n"))


def function_word_rates(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, word, n_words, rate per 1,000 words; every group has every listed word."""
    return word_counts(docs, by).select(by, "word", "n_words", (1000.0 * F.col("n") / F.greatest("n_words", F.lit(1))).alias("rate"))


def reference_statistics(docs: DataFrame, chunk: int = 1000) -> DataFrame:
    """word, mean, sd (at least 0.5) of rates over chunks of a document's words; chunks that are not full are left out."""
    rows = docs.select("doc_id", F.posexplode(F.transform(word_list(F.coalesce("text", F.lit(""))), F.lower)).alias("i", "word"))
    rows = rows.withColumn("part", F.floor(F.col("i") / chunk))
    full = rows.groupBy("doc_id", "part").agg(F.count("*").alias("n")).where(F.col("n") == chunk)
    chunks = max(1, full.count())
    hits = rows.where(F.col("word").isin(FUNCTION_WORDS)).groupBy("doc_id", "part", "word").agg(F.count("*").alias("c")).join(full, ["doc_id", "part"])
    rate = 1000.0 * F.col("c") / chunk
    sums = hits.groupBy("word").agg(F.sum(rate).alias("s"), F.sum(rate * rate).alias("q"))
    mean = F.col("s") / chunks
    return sums.select("word", mean.alias("mean"), F.greatest(F.lit(0.5), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / chunks - mean * mean))).alias("sd"))


def corpus_statistics(docs: DataFrame, chunk: int = 1000, ranges: int = 256) -> DataFrame:
    """word, mean, sd (at least 0.5) of rates over chunks of the corpus's words, in the order of doc_id, then text.

    Chunks run across texts, so only the last remainder is left out. Every listed word has a row. Words are numbered by running
    sums per range of doc_id and a table of the ranges' offsets; without one full chunk, all means are 0.
    """
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.001)))
    # Long to double keeps order, so a range never splits the order of doc_id; nulls come first, as in the window.
    at = F.lit(0)
    if cuts:
        at = F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda x: x < F.col("doc_id").cast("double"))), F.lit(0))
    at = F.when(F.col("doc_id").isNull(), -1).otherwise(at)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), at.alias("range")).withColumn("n", F.size(word_list(F.col("text"))).cast("long"))
    offsets, words = [], 0
    for r, n in sorted(tuple(x) for x in rows.groupBy("range").agg(F.sum("n")).collect()):  # a row per range
        offsets.append((r, words))
        words += n
    chunks = words // chunk
    table = docs.sparkSession.createDataFrame(offsets, "range int, base long")
    order = Window.partitionBy("range").orderBy("doc_id", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("first", F.sum("n").over(order) - F.col("n")).join(F.broadcast(table), "range")
    listed = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    numbered = F.transform(word_list(F.col("text")), lambda x, i: F.struct((F.floor((F.col("base") + F.col("first") + i) / chunk)).alias("part"), F.lower(x).alias("word")))
    found = rows.select(F.explode(F.filter(numbered, lambda x: F.array_contains(listed, x["word"]))).alias("h")).select("h.*").where(F.col("part") < chunks)
    rate = 1000.0 * F.col("c") / chunk
    sums = found.groupBy("part", "word").agg(F.count("*").alias("c")).groupBy("word").agg(F.sum(rate).alias("s"), F.sum(rate * rate).alias("q"))
    sums = docs.sparkSession.createDataFrame([(w,) for w in FUNCTION_WORDS], "word string").join(sums, "word", "left").fillna(0.0)
    mean = F.col("s") / max(1, chunks)
    return sums.select("word", mean.alias("mean"), F.greatest(F.lit(0.5), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / max(1, chunks) - mean * mean))).alias("sd"))


def burrows_delta(rates: DataFrame, profile: DataFrame, reference: DataFrame, by: str) -> DataFrame:
    """by, delta: mean absolute difference of z-scores, rates drawn towards the reference by 250 words of prior weight."""
    # Profile and reference have a row per function word.
    joined = rates.join(F.broadcast(profile.select("word", F.col("rate").alias("_p"))), "word").join(F.broadcast(reference), "word")
    weight = F.col("n_words") / (F.col("n_words") + PRIOR_WORDS)
    drawn = weight * F.col("rate") + (1 - weight) * F.col("mean")
    return joined.groupBy(by).agg(F.avg(F.abs((drawn - F.col("mean")) / F.col("sd") - (F.col("_p") - F.col("mean")) / F.col("sd"))).alias("delta"))


def feature_distance(features: DataFrame, profile: dict[str, float], by: str) -> DataFrame:
    """by, rms of scaled differences to the profile's features."""
    z = [((F.col(k) - F.lit(profile[k])) / scale) for k, scale in FEATURE_SCALE.items() if k in profile]
    square = sum((x * x for x in z), F.lit(0.0))
    return features.select(by, F.sqrt(square / len(z)).alias("rms"))


def voice_match(deltas: DataFrame, distances: DataFrame, by: str) -> DataFrame:
    """by, match: 100 less half of each distance's share of its range."""
    far = 0.5 * unit(F.col("delta"), *DELTA_RANGE) + 0.5 * unit(F.col("rms"), *FEATURE_RANGE)
    return deltas.join(distances, by).select(by, F.round(100 * (1 - far), 1).alias("match"))


def top_differences(features: DataFrame, profile: dict[str, float], by: str, most: int = 3, least: float = 0.5) -> DataFrame:
    """by, feature, z of the largest differences."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), ((F.col(k) - F.lit(profile[k])) / FEATURE_SCALE[k]).alias("z")) for k in FEATURE_SCALE if k in profile])
    rows = features.select(by, F.explode(pairs).alias("d")).select(by, "d.*").where(F.abs("z") >= least)
    order = Window.partitionBy(by).orderBy(F.abs("z").desc(), "feature")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
