"""Quiz material without a parser: question sentences, gaps, swapped numbers, options in a fixed order, expansions, review cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let


#: The words of a sentence that makes a question, least and most; and how it ends.
ASKED, STATED = (6, 45), r"[.]\s*$"


def question_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences of 6 to 45 words that end in a stop and do not ask."""
    return sentences.where(F.col("n_words").between(*ASKED) & F.col("sentence").rlike(STATED))


def gaps(sentences: DataFrame, letters: int = 7) -> DataFrame:
    """doc_id, sent_idx, key, prompt: the longest word that occurs once in its sentence is blanked; ties go to the first."""

    def longest(w: Column) -> Column:
        once = let(F.transform(w, F.lower), lambda low: F.filter(w, lambda x: (F.length(x) >= letters) & (F.size(F.array_remove(low, F.lower(x))) == F.size(low) - 1)))
        return F.aggregate(once, F.lit(None).cast("string"), lambda a, x: F.when(F.length(a) >= F.length(x), a).otherwise(x))

    # A row per key, not a condition on it: Spark would put a condition below the projection and look for words and key once more in it.
    key = let(F.col("words"), lambda w: F.when(F.size(w).between(*ASKED), longest(w)))
    rows = sentences.where(F.col("sentence").rlike(STATED)).select("doc_id", "sent_idx", "sentence", F.explode(F.array_compact(F.array(key))).alias("key"))
    prompt = F.concat(F.expr("substring(sentence, 1, locate(key, sentence) - 1)"), F.lit("____"), F.expr("substring(sentence, locate(key, sentence) + length(key))"))
    return rows.where("locate(key, sentence) > 0").select("doc_id", "sent_idx", "key", prompt.alias("prompt"))


def swapped_numbers(text: Column) -> Column:
    """The first two different numbers exchanged; null without them."""
    pattern = r"^(.*?)([0-9]+)([^0-9]+)([0-9]+)(.*)$"
    a, b = F.regexp_extract(text, pattern, 2), F.regexp_extract(text, pattern, 4)
    return F.when(text.rlike(pattern) & (a != b), F.concat(F.regexp_extract(text, pattern, 1), b, F.regexp_extract(text, pattern, 3), a, F.regexp_extract(text, pattern, 5)))


def options_in_order(options: DataFrame) -> DataFrame:
    """qid, place, option: options by the SHA-1 of question and option, the same on every run."""
    order = Window.partitionBy("qid").orderBy(F.sha1(F.concat_ws(":", "qid", "option")))
    return options.select("qid", (F.row_number().over(order) - 1).cast("long").alias("place"), "option")


def expansion_of(words: Column, abbreviation: Column) -> Column:
    """The shortest run of words at the end whose initials spell the abbreviation, or null."""
    n = F.size(words)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(words, F.greatest(n - k + 1, F.lit(1)), k))
    spelt = F.filter(ends, lambda w: F.upper(F.concat_ws("", F.transform(w, lambda x: F.substring(x, 1, 1)))) == F.upper(abbreviation))
    return F.when(n > 0, F.concat_ws(" ", F.get(spelt, F.lit(0))))


#: An abbreviation in brackets after a blank.
BRACKETED = r" \([A-Z]{2,6}\)"


def glossary(lines: DataFrame) -> DataFrame:
    """doc_id, term, expansion of the abbreviations that are defined in brackets; the first definition of a term counts."""
    some = lines.where(F.col("line").rlike(BRACKETED))  # a definition is looked for from every letter on, to the end of its words
    found = some.select("doc_id", "line_idx", F.explode(F.regexp_extract_all("line", F.lit(rf"[A-Za-z][A-Za-z -]*{BRACKETED}"), F.lit(0))).alias("m"))
    rows = found.select("doc_id", "line_idx", F.regexp_extract("m", r"\(([A-Z]+)\)", 1).alias("term"), F.split(F.regexp_extract("m", r"^(.*) \(", 1), " ").alias("w"))
    rows = rows.withColumn("expansion", expansion_of(F.col("w"), F.col("term"))).where("expansion <> ''")
    return rows.groupBy("doc_id", "term").agg(F.min_by("expansion", "line_idx").alias("expansion"))


def new_cards(offered: DataFrame, cards: DataFrame) -> DataFrame:
    """Offered cards whose id no card has yet, one per id; schedules of existing cards stay."""
    return offered.join(cards.select("card_id"), "card_id", "left_anti").groupBy("card_id").agg(F.min("front").alias("front"))


def next_level(history: DataFrame, passed: float = 70, levels: int = 4) -> DataFrame:
    """doc_id, level: one up after a pass, one down after a fail, by the last answer; starts at 1."""
    last = history.groupBy("doc_id").agg(F.max_by(F.struct("level", "score"), "at").alias("l"))
    step = F.when(F.col("l.score") >= passed, 1).otherwise(-1)
    return last.select("doc_id", F.least(F.greatest(F.col("l.level") + step, F.lit(1)), F.lit(levels)).cast("long").alias("level"))
