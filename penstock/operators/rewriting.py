"""Rewrites of sentences as candidates: phrases, paired dashes, contractions; and the choice among scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import capital
from ..functions.text import let
from .issues import LEXICONS

#: Contractions that expand without doubt.
EXPANSIONS = {"don't": "do not", "doesn't": "does not", "isn't": "is not", "aren't": "are not", "can't": "cannot", "won't": "will not", "it's": "it is", "we're": "we are", "they're": "they are"}


def tidy(text: Column) -> Column:
    """One space between words, none before marks, a capital first."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" ([,.;:!?])", "$1"))
    t = F.regexp_replace(t, r"^[,;:] ?", "")
    return let(t, lambda x: F.concat(capital(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))))


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Each phrase in the place of whole words by its wording, one after the other; a text with none of them is looked through once."""
    whole = lambda phrase: rf"(?i)(^|[^A-Za-z])(?:{phrase})($|[^A-Za-z])"
    out = text
    for phrase, plain in pairs:
        out = F.regexp_replace(out, whole(phrase), f"$1{plain}$2")
    return F.when(text.rlike(whole("|".join(p for p, _ in pairs))), out).otherwise(text)


def simplified(text: Column) -> Column:
    """Wordy phrases in plainer words, fillers dropped."""
    pairs = [(p, r) for name in ("wordy_phrase", "filler") for p, r in LEXICONS[name].items() if r is not None]
    return tidy(replaced(text, sorted(pairs, key=lambda x: (-len(x[0]), x[0]))))


def dashes_paired(text: Column) -> Column:
    """A remark between two spaced dashes goes between commas."""
    return F.regexp_replace(text, r"([a-z]) [-–] ([^-–]+) [-–] ([a-z])", "$1, $2, $3")


def expanded(text: Column) -> Column:
    return tidy(replaced(text, list(EXPANSIONS.items())))


def candidates(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, transform, text of each rewrite that changes its sentence, and of all in a row."""
    s = F.col("sentence")
    rows = sentences.select("doc_id", "sent_idx", "sentence", simplified(s).alias("phrase_simplify"), dashes_paired(s).alias("dash_tidy"), expanded(s).alias("contractions"))
    rows = rows.withColumn("all", dashes_paired(F.col("phrase_simplify")))  # in steps, so that each rewrite is made once
    rows = rows.withColumn("all", expanded(F.col("all")))
    made = [F.struct(F.lit(n).alias("transform"), F.col(n).alias("text")) for n in ("phrase_simplify", "dash_tidy", "contractions", "all")]
    rows = rows.select("doc_id", "sent_idx", "sentence", F.explode(F.array(*made)).alias("c"))
    return rows.select("doc_id", "sent_idx", "sentence", "c.transform", "c.text").where("text <> sentence")


def choose(scored: DataFrame, margin: float = 0.0) -> DataFrame:
    """The best candidate of a sentence whose score beats the original's by the margin; ties go to the first transform."""
    order = Window.partitionBy("doc_id", "sent_idx").orderBy(F.desc("score"), "transform")
    return scored.where(F.col("score") > F.col("base") + margin).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
