"""Rules over the order of sentences, figures and changes, by windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import own_text
from .reports import section_of

#: Our own transitions by group, and empty wrappers that may open a sentence.
TRANSITIONS = {
    "addition": ["moreover", "furthermore", "in addition", "additionally", "also"],
    "contrast": ["however", "nevertheless", "on the other hand", "still"],
    "result": ["therefore", "thus", "consequently", "as a result", "hence"],
    "order": ["first", "second", "finally", "then", "next"],
    "example": ["for example", "for instance"],
}
WRAPPERS = ["it is important to note that", "it is worth noting that", "it should be noted that", "it is clear that", "note that"]
_EVERY = sorted({t for g in TRANSITIONS.values() for t in g}, key=lambda t: (-len(t), t))
OPENING = "(?i)^(" + "|".join(_EVERY) + "),"
STOCK_OPENER = "(?i)^(?:(?:(?:" + "|".join(_EVERY) + ")[ ]?,|(?:" + "|".join(sorted(WRAPPERS, key=lambda t: (-len(t), t))) + "))[ ,]*){1,4}"


def opening_transition(sentence: Column) -> Column:
    """The lower-cased transition that opens a sentence before a comma, or null."""
    found = F.lower(F.regexp_extract(sentence, OPENING, 1))
    return F.when(found != "", found)


def stock_opener_length(sentence: Column, least: int = 6) -> Column:
    """Characters of stacked transitions and wrappers at a sentence's start; 0 where fewer than `least` words would be left."""
    n = F.length(F.regexp_extract(sentence, STOCK_OPENER, 0))
    rest = F.substr(sentence, n + 1)
    return F.when(F.size(F.filter(F.split(rest, r"\s+"), lambda w: w != "")) >= least, n).otherwise(0)


def crowded_transitions(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, transition, repeated (it opens one of the five sentences before), dense (of the last three sentences more than one has a transition)."""
    order = Window.partitionBy(*own_text(sentences)).orderBy("sent_idx")
    rows = sentences.withColumn("transition", opening_transition(F.col("sentence")))
    before = F.collect_list("transition").over(order.rowsBetween(-5, -1))
    dense = F.count("transition").over(order.rowsBetween(-2, 0)) > 1
    return rows.withColumn("repeated", F.array_contains(before, F.col("transition"))).withColumn("dense", dense).where("transition is not null and (repeated or dense)").select("doc_id", "sent_idx", "transition", "repeated", "dense")


def opener_triggers(sentences: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, sent_idx, opener: sentences whose first word opens three or more of the four sentences before."""
    own = own_text(sentences)
    order = Window.partitionBy(*own).orderBy("sent_idx").rowsBetween(-4, -1)
    rows = sentences.select(*own, "sent_idx", F.lower(F.regexp_extract("sentence", "[A-Za-z]+", 0)).alias("opener"))
    same = F.size(F.filter(F.collect_list("opener").over(order), lambda x: x == F.col("opener")))
    return rows.withColumn("_k", same).where(F.col("_k") >= least).select("doc_id", "sent_idx", "opener")


def first_mention_order(mentions: DataFrame) -> DataFrame:
    """doc_id, kind, number, place: the n-th item introduced should be n; it is out of order if its number is larger and number - 1 did not come before."""
    first = mentions.groupBy("doc_id", "kind", "number").agg(F.min("start").alias("start"))
    rows = first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("start")).cast("long"))
    # Where the number before this one was introduced: its neighbour in order of numbers, if there is no gap.
    by_number = Window.partitionBy("doc_id", "kind").orderBy("number")
    rows = rows.withColumn("_before", F.when(F.lag("number").over(by_number) == F.col("number") - 1, F.lag("start").over(by_number)))
    late = F.col("_before").isNull() | (F.col("_before") >= F.col("start"))
    return rows.where((F.col("number") > F.col("place")) & late).select("doc_id", "kind", "number", "place")


def with_sections(lines: DataFrame) -> DataFrame:
    """lines with heading, section (of the last known heading, `body` before the first) and in_body: neither a heading nor a reference."""
    order = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("heading", section_of(F.col("line")).isNotNull())
    section = F.coalesce(F.last(section_of(F.col("line")), ignorenulls=True).over(order), F.lit("body"))
    return own.withColumn("section", section).withColumn("in_body", ~F.col("heading") & (F.col("section") != "references"))


def long_abstracts(lines: DataFrame, most: int = 250) -> DataFrame:
    """doc_id, n_words of abstracts over `most` words."""
    words = F.size(F.filter(F.split("line", r"\s+"), lambda w: w != ""))
    own = with_sections(lines).where("section = 'abstract' and not heading").groupBy("doc_id").agg(F.sum(words).alias("n_words"))
    return own.where(F.col("n_words") > most)


PAST, PRESENT = r"(?i)\b(?:was|were|had|did|[a-z]+ed)\b", r"(?i)\b(?:is|are|has|does|shows|gives|uses)\b"


def tense_votes(lines: DataFrame) -> DataFrame:
    """doc_id, section, line_idx: body lines in the other tense than most of their section; lines of both or no tense do not vote."""
    past, present = F.col("line").rlike(PAST), F.col("line").rlike(PRESENT)
    votes = with_sections(lines).where("in_body").withColumn("vote", F.when(past & ~present, 1).when(present & ~past, -1).otherwise(0))
    section = Window.partitionBy("doc_id", "section")
    return votes.withColumn("_sum", F.sum("vote").over(section)).where("vote <> 0 and vote * _sum < 0").select("doc_id", "section", "line_idx")


QUANTITY = r"(?i)\b(?:mass|weight|length|width|height|pressure|temperature|force|speed|voltage|current) (?:was|is|of|=) [0-9]+(?:\.[0-9]+)?([^\n]{0,4})"


def missing_units(lines: DataFrame) -> DataFrame:
    """doc_id, line_idx: result lines where a quantity's number is followed by no unit."""
    own = with_sections(lines).where("section in ('results', 'discussion') and not heading")
    return own.where(F.col("line").rlike(QUANTITY) & ~F.trim(F.regexp_extract("line", QUANTITY, 1)).rlike("^(?:%|°|[A-Za-z]{1,3})")).select("doc_id", "line_idx")


def rhythm_series(sentences: DataFrame) -> DataFrame:
    """doc_id, sent_idx, n_words with the document's mean and standard deviation, for a chart."""
    own = Window.partitionBy(*own_text(sentences))
    return sentences.select("doc_id", "sent_idx", "n_words", F.avg("n_words").over(own).alias("mean"), F.stddev_pop("n_words").over(own).alias("sd"))


def short_pairs(sentences: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, sent_idx, merged: a sentence of at most `most` words joined with the next one of the paragraph, if that is as short."""
    order = Window.partitionBy(*own_text(sentences), "para_idx").orderBy("sent_idx")
    rows = sentences.withColumn("_next", F.lead("sentence").over(order)).withColumn("_n", F.lead("n_words").over(order))
    head, tail = F.regexp_replace("sentence", r"[.!]\s*$", ""), F.concat(F.lower(F.left("_next", F.lit(1))), F.expr("substring(_next, 2)"))
    return rows.where((F.col("n_words") <= most) & (F.col("_n") <= most) & ~F.col("sentence").rlike(r"\?\s*$")).select("doc_id", "sent_idx", F.concat(head, F.lit(", and "), tail).alias("merged"))


def assembled_changes(changes: DataFrame) -> DataFrame:
    """Changes (doc_id, start, end, replacement) with new_start and new_end in the rewritten text: a running sum of length differences."""
    order = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    delta = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(order), F.lit(0))
    return changes.withColumn("new_start", (F.col("start") + delta).cast("long")).withColumn("new_end", (F.col("new_start") + F.length("replacement")).cast("long"))


def pending_changes(docs: DataFrame, changes: DataFrame, within: int = 300) -> DataFrame:
    """doc_id, change_id, new_start (null: stale) of undecided changes in the edited text.

    Accepted changes before it shift a change; where its words are not there, they are looked for within so many characters.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "change_id").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.when(F.col("decision") == "accepted", F.length("replacement") - F.length("original")).otherwise(0)
    rows = changes.withColumn("_at", F.col("start") + F.coalesce(F.sum(moved).over(order), F.lit(0))).where("decision is null").join(docs.select("doc_id", "text"), "doc_id")
    low = F.greatest(F.lit(0), F.col("_at") - within)
    window = F.substr("text", (low + 1).cast("int"), (F.col("_at") - low + F.length("original") + within).cast("int"))
    there = F.substr("text", (F.col("_at") + 1).cast("int"), F.length("original")) == F.col("original")
    near = F.instr(window, F.col("original"))
    found = F.when(there, F.col("_at")).when((F.trim("original") != "") & (near > 0), low + near - 1)
    return rows.select("doc_id", "change_id", found.cast("long").alias("new_start"))
