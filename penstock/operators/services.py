"""Whole tasks composed of the operators: analysing texts, checking reports, profiling writers, summing up a walkthrough.

Each gives DataFrames that share doc_id; nothing runs until they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs, sentences
from . import reports
from .detectors import analyse, protected, protected_islands
from .fingerprint import fingerprints
from .fit import frequent_terms
from .flow import long_abstracts, missing_units, tense_votes, with_sections
from .graph import central_sentences_any_length
from .metrics import score_documents


def segment(docs: DataFrame) -> dict[str, DataFrame]:
    """paragraphs with offsets, sentences, and lines with section, heading and in_body."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_idx", "line"))
    return {"paragraphs": paragraphs(docs), "sentences": sentences(docs), "lines": with_sections(lines)}


def analyse_documents(docs: DataFrame) -> dict[str, DataFrame]:
    """scores, issues and protected spans."""
    return {"scores": score_documents(docs), "issues": analyse(docs), "protected": protected_islands(protected(docs)).drop("_row")}


def report_issues(lines: DataFrame) -> DataFrame:
    """doc_id, rule, about: every check of a report (doc_id, line_idx, line) as one relation."""
    numbered = F.concat_ws(" ", "kind", "number")
    lines = lines.persist()  # a dozen checks read them, each of which would make them anew
    parts = [
        reports.structure_issues(lines).select("doc_id", "rule", F.col("section").alias("about")),
        reports.abbreviations(lines).select("doc_id", "rule", F.col("abbr").alias("about")),
        reports.figures(lines).select("doc_id", "rule", numbered.alias("about")),
        reports.units(lines).select("doc_id", "rule", F.col("surface").alias("about")),
        long_abstracts(lines).select("doc_id", F.lit("structure.abstract_long").alias("rule"), F.col("n_words").cast("string").alias("about")),
        tense_votes(lines).select("doc_id", F.lit("tense.mixed").alias("rule"), F.concat_ws(":", "section", "line_idx").alias("about")),
        missing_units(lines).select("doc_id", F.lit("units.missing").alias("rule"), F.col("line_idx").cast("string").alias("about")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def walkthrough(docs: DataFrame) -> dict[str, DataFrame]:
    """The most frequent long words of each document, and its sentences by centrality."""
    return {"terms": frequent_terms(docs), "sentences": central_sentences_any_length(sentences(docs))}


def style_profiles(docs: DataFrame, by: str) -> DataFrame:
    return fingerprints(docs, by)
