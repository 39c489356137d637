"""Style fingerprints of writers: rates and shares over all sentences and words of a group, from sums per row.

Each row gives a struct of counts from its own text; groups add them up with partial aggregation, so a writer with a third
of all rows costs no more than others. Only parse-free features are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, match_count, sentence_array, word_list
from .flow import OPENING
from .metrics import PASSIVE, total

FIRST = ["i", "me", "my", "mine", "we", "us", "our", "ours", "myself", "ourselves"]
PRONOUNS = ["i", "he", "she", "it", "we", "they", "you", "this", "that", "these", "those"]
#: feature -> pattern counted in the text, per 1,000 words.
MARKS = {
    "commas": ",", "semicolons": ";", "colons": ":", "parentheses": r"\(", "questions": r"\?", "exclamations": "!", "dashes": "[—–]", "quotes": '["“]',
    "digits": "[0-9]+", "contractions": r"(?i)\b[a-z]+(?:n't|'re|'ve|'ll|'d|'m)\b",
}


def counts_of(text: Column) -> Column:
    """What a text adds to its writer's sums."""
    t = F.coalesce(text, F.lit(""))

    def of(x: Column) -> Column:
        lengths = F.transform(x["s"], lambda y: F.size(word_list(y["sentence"])))
        openers = F.transform(x["s"], lambda y: F.lower(F.regexp_extract(y["sentence"], "[A-Za-z]+", 0)))
        share = lambda test: F.size(F.filter(x["s"], test)).cast("double")
        return F.struct(
            F.size(x["s"]).cast("double").alias("sents"),
            F.size(x["w"]).cast("double").alias("words"),
            total(x["w"], F.length).alias("letters"),
            total(lengths).alias("len1"),
            total(lengths, lambda n: n * n).alias("len2"),
            F.size(F.filter(lengths, lambda n: n > 30)).cast("double").alias("long"),
            F.size(F.filter(lengths, lambda n: n < 8)).cast("double").alias("short"),
            F.size(F.filter(x["w"], lambda w: F.length(w) > 6)).cast("double").alias("long_words"),
            F.size(F.filter(x["w"], lambda w: w.isin(FIRST))).cast("double").alias("first"),
            F.size(F.filter(openers, lambda o: o.isin(PRONOUNS))).cast("double").alias("pronoun_openers"),
            F.size(F.filter(openers, lambda o: o.isin("the", "a", "an"))).cast("double").alias("article_openers"),
            share(lambda y: y["sentence"].rlike(OPENING)).alias("transitions"),
            share(lambda y: y["sentence"].rlike(PASSIVE)).alias("passive"),
            *[match_count(t, p).cast("double").alias(m) for m, p in MARKS.items()],
        )

    return let(F.struct(sentence_array(t).alias("s"), F.transform(word_list(t), F.lower).alias("w")), of)


def fingerprints(docs: DataFrame, by: str, least: int = 300) -> DataFrame:
    """by, n_words and 21 features of each group of at least `least` words; features have four digits."""
    parts = ["sents", "words", "letters", "len1", "len2", "long", "short", "long_words", "first", "pronoun_openers", "article_openers", "transitions", "passive", *MARKS]
    sums = docs.select(by, counts_of(F.col("text")).alias("c")).groupBy(by).agg(*[F.sum(f"c.{p}").alias(p) for p in parts]).where(F.col("words") >= least)
    c = F.col
    mean = c("len1") / c("sents")
    four = lambda x, name: F.round(x, 4).alias(name)
    shares = {"long_share": "long", "short_share": "short", "pronoun_opener_share": "pronoun_openers", "article_opener_share": "article_openers", "transition_share": "transitions", "passive_share": "passive"}
    return sums.where("sents > 0").select(
        by, c("words").cast("long").alias("n_words"), four(mean, "length_mean"), four(F.sqrt(F.greatest(c("len2") / c("sents") - mean * mean, F.lit(0.0))), "length_sd"),
        four(c("letters") / c("words"), "word_length"), four(c("long_words") / c("words"), "long_word_share"), four(1000.0 * c("first") / c("words"), "first_person_per_1000"),
        *[four(c(p) / c("sents"), name) for name, p in shares.items()], *[four(1000.0 * c(m) / c("words"), f"{m}_per_1000") for m in MARKS],
    )
