"""A learner's side: quiz totals, cards from a document, marks carried over, revision lists, the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def graded(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answer, an empty one where there is none; correct is null for open questions (without a key)."""
    given = F.lower(F.trim(F.coalesce("answer", F.lit(""))))
    return questions.join(answers, ["doc_id", "qid"], "left").select("doc_id", "qid", "prompt", "key", F.coalesce("answer", F.lit("")).alias("answer"), F.when(F.col("key").isNotNull(), given == F.lower("key")).alias("correct"), "score")


def quiz_totals(results: DataFrame) -> DataFrame:
    """doc_id, total: percent of closed questions that are correct; without closed ones the mean score of the open ones."""
    closed = F.count("correct")
    right = F.sum(F.when(F.col("correct"), 1).otherwise(0))
    return results.groupBy("doc_id").agg(F.round(F.when(closed > 0, 100.0 * right / closed).otherwise(F.avg(F.coalesce("score", F.lit(0.0)))), 1).alias("total"))


def cards_from(results: DataFrame, glossary: DataFrame) -> DataFrame:
    """card_id, doc_id, source, front, back: a card for each wrong closed answer and for each term with a definition."""
    quiz = results.where("correct = false").select(F.concat_ws(":", F.lit("q"), "doc_id", "qid").alias("card_id"), "doc_id", F.lit("quiz").alias("source"), F.col("prompt").alias("front"), F.col("key").alias("back"))
    terms = glossary.where("definition is not null and definition <> ''")
    terms = terms.select(F.concat_ws(":", F.lit("g"), "doc_id", F.lower("term")).alias("card_id"), "doc_id", F.lit("glossary").alias("source"), F.concat(F.lit("Define: "), "term").alias("front"), F.col("definition").alias("back"))
    first = Window.partitionBy("card_id").orderBy("front", "back")
    return quiz.unionByName(terms).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def marks_carried(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, para_idx, mark: a paragraph keeps its mark if its text (but for white space and case) is unchanged; the last of equal ones counts."""
    key = F.lower(F.trim(F.regexp_replace("para_text", r"\s+", " ")))
    marks = old.where("mark is not null").select("doc_id", "para_idx", "mark", key.alias("_k")).groupBy("doc_id", "_k").agg(F.max_by("mark", "para_idx").alias("mark"))
    return new.select("doc_id", "para_idx", key.alias("_k")).join(marks, ["doc_id", "_k"]).select("doc_id", "para_idx", "mark")


def revision_list(weak: DataFrame) -> DataFrame:
    """doc_id, topics: missed concepts, then weak ones, each once in the order met."""
    return weak.select("doc_id", F.array_join(F.array_distinct(F.concat(F.split("missed", r"\|"), F.split("weak", r"\|"))), "|").alias("topics"))


def dashboard(reviews: DataFrame, cards: DataFrame, now_min: float) -> DataFrame:
    """One row: cards, cards due, reviews of the last seven days, and the share of them that were passed (grade 2 or more)."""
    recent = (F.col("at_min") > now_min - 7 * 1440) & (F.col("at_min") <= now_min)
    week = reviews.where(recent).select(F.lit(0).alias("card"), F.lit(0).alias("due"), F.lit(1).alias("review"), (F.col("grade") >= 2).cast("double").alias("ok"))
    deck = cards.select(F.lit(1).alias("card"), (F.col("due_min") <= now_min).cast("int").alias("due"), F.lit(0).alias("review"), F.lit(None).cast("double").alias("ok"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return week.unionByName(deck).agg(total("card").alias("cards"), total("due").alias("due"), total("review").alias("reviews"), F.round(F.avg("ok"), 4).alias("passed"))


def bulk_accepted(changes: DataFrame, least: float = 0.8) -> DataFrame:
    """Undecided changes of at least such a confidence that overlap no other change."""
    o = changes.select(F.col("doc_id").alias("_d"), F.col("change_id").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col("doc_id") == F.col("_d")) & (F.col("change_id") != F.col("_c")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return changes.where(F.col("decision").isNull() & (F.col("confidence") >= least)).join(o, hit, "left_anti").select("doc_id", "change_id")


def swap_terms(statement, a, b):
    """The statement with two terms exchanged."""
    return F.replace(F.replace(F.replace(statement, a, F.lit("\u0001")), b, a), F.lit("\u0001"), b)


def picked(key, choices: list[str]):
    """One of the choices by the first 28 bits of the key's SHA-1."""
    return F.get(F.array(*[F.lit(c) for c in choices]), (F.conv(F.substring(F.sha1(key), 1, 7), 16, 10).cast("long") % len(choices)).cast("int"))
