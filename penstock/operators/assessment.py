"""Copying, grading of closed and open answers, quiz totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def word_grams(text: Column, n: int = 4) -> Column:
    """Runs of n lower-cased words as strings."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))
    grams = lambda w: F.when(
        F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
    ).otherwise(F.array().cast("array<string>"))
    return let(words, grams)


def copied_share(answer: Column, source_grams: Column) -> Column:
    """Share of the answer's 4-grams that are among the source's (a column, so that they are made once per row)."""

    def share(a: Column) -> Column:
        # The grams both have are found by hash; only they are looked up for each gram of the answer.
        known = let(F.array_intersect(a, source_grams), lambda both: F.size(F.filter(a, lambda g: F.array_contains(both, g))))
        return F.when(F.size(a) > 0, known / F.size(a).cast("double")).otherwise(0.0)

    return let(word_grams(answer), share)


def copied_from(texts: DataFrame, sources: DataFrame, key: str, n: int = 4) -> DataFrame:
    """key, n_grams, copied: how many n-grams of each text occur in any source. Grams meet in one hash join."""
    known = sources.select(F.explode(F.array_distinct(word_grams(F.col("text"), n))).alias("g")).distinct()
    mine = texts.select(key, F.explode(word_grams(F.col("text"), n)).alias("g"))
    hit = mine.join(known.withColumn("hit", F.lit(1)), "g", "left")
    return hit.groupBy(key).agg(F.count("*").alias("n_grams"), F.count("hit").alias("copied"))


def grade_open_approx(answers: DataFrame) -> DataFrame:
    """qid, coverage, copied, score: concept words found, without vectors (lexical form, so `_approx`)."""
    words = F.filter(F.split(F.trim("answer"), r"\s+"), lambda x: x != "")
    concepts = F.filter(F.split("concepts", r"\|"), lambda x: x != "")
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower("answer"), "[^a-z0-9]+", " "), F.lit(" "))
    found = F.size(F.filter(concepts, lambda c: F.contains(low, F.concat(F.lit(" "), F.lower(c), F.lit(" ")))))
    n = F.size(concepts)
    rows = answers.withColumn("_source", word_grams(F.col("source"))).select(
        "qid", F.size(words).alias("n"), F.when(n > 0, found / n.cast("double")).otherwise(0.0).alias("coverage"), copied_share(F.col("answer"), F.col("_source")).alias("share")
    )
    copied = (F.col("n") >= 8) & (F.col("share") >= 0.6)
    score = F.when(F.col("n") < 3, 0.0).otherwise(F.when(copied, F.least(F.lit(50.0), 100 * F.col("coverage"))).otherwise(100 * F.col("coverage")))
    return rows.select("qid", F.round("coverage", 4).alias("coverage"), copied.alias("copied"), F.round(score, 1).alias("score"))
