"""Phrases in all their forms: built from rules, found leftmost and longest in one pass over a text, and said more plainly in the same form.

A phrase is words with blanks between; a leading verb may stand in any of its five forms, and the plainer wording follows it ("made a comparison
of" gives "compared"). A match starts and ends where no letter, digit, underscore or hyphen goes on; white space between words may be any;
case does not count and a curly apostrophe is a straight one. Matches do not overlap: the first start wins, then the longest.

Texts are cut into pieces (runs of word signs, apostrophes, white space, other signs) that walk down a trie of pieces; words that start no phrase
are passed over, and a step back is at most the longest phrase. Rows of a batch go out in blocks, whatever a text's length. A null or empty text gives no row;
rows that share an id are told apart by `_row`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .issues import LEXICONS

FORMS = ("base", "s", "past", "part", "ing")
#: Verbs whose past or participle no rule gives: base -> (past, participle).
IRREGULAR = {"make": ("made", "made"), "give": ("gave", "given"), "take": ("took", "taken"), "do": ("did", "done"), "hold": ("held", "held"), "choose": ("chose", "chosen")}
#: Verbs that add little to the noun after them.
LIGHT = ("make", "give", "take", "do", "hold", "perform", "conduct", "provide", "produce", "carry out", "undertake")
#: A noun with its article, the word that ties its object to it, and the verb that it hides.
HIDDEN = [
    tuple(line.split("/"))
    for line in (
        "an analysis/of/analyse", "an assessment/of/assess", "a calculation/of/calculate", "a comparison/of/compare", "a description/of/describe", "an evaluation/of/evaluate", "an examination/of/examine",
        "an explanation/of/explain", "an investigation/of/investigate", "a measurement/of/measure", "a study/of/study", "a test/of/test", "a summary/of/summarise", "a review/of/review", "an estimate/of/estimate",
        "an inspection/of/inspect", "a prediction/of/predict", "a discussion/of/discuss", "a survey/of/survey", "a definition/of/define", "a choice/of/choose", "a selection/of/select", "an observation/of/observe",
        "a reduction/in/reduce", "an improvement/in/improve", "an increase/in/increase", "a change/to/change", "an adjustment/to/adjust", "an answer/to/answer", "a correction/to/correct",
    )
]
#: Adjectives in phrases of manner and nature, with their adverbs by rule.
MANNERS = "careful quick slow clear direct simple efficient accurate precise consistent similar different rapid reliable formal effective successful random gradual regular".split()
AMOUNTS = {"large number": "many", "great number": "many", "huge number": "many", "small number": "few", "limited number": "few", "large amount": "much", "great deal": "much", "small amount": "little"}


class Phrase(NamedTuple):
    key: str  # the phrase in its base form
    surface: str  # this form, lower case
    form: str
    wording: str | None  # the plainer wording in this form; "" drops it, None flags only


def adverb(adjective: str) -> str:
    if adjective.endswith("le"):
        return adjective[:-1] + "y"
    return adjective[:-1] + "ily" if adjective.endswith("y") else adjective + "ly"


def verb_forms(verb: str) -> dict[str, str]:
    """The forms of a verb; words after the first stay as they are."""
    head, _, tail = verb.partition(" ")
    prefix, stem = ("under", head[5:]) if head.startswith("under") and head[5:] in IRREGULAR else ("", head)
    vowel_y = stem.endswith("y") and stem[-2] not in "aeiou"
    third = stem[:-1] + "ies" if vowel_y else stem + ("es" if stem.endswith(("s", "sh", "ch", "x", "o")) else "s")
    regular = stem + "d" if stem.endswith("e") else stem[:-1] + "ied" if vowel_y else stem + "ed"
    past, part = IRREGULAR.get(stem, (regular, regular))
    going = stem[:-1] + "ing" if stem.endswith("e") and not stem.endswith("ee") else stem + "ing"
    return {f: f"{prefix}{x} {tail}".strip() for f, x in zip(FORMS, (stem, third, past, part, going))}


def build_phrases() -> list[Phrase]:
    """Every phrase in every form, one row per surface: of two forms alike the first stays."""
    out: dict[str, Phrase] = {}

    def add(key: str, surface: str, form: str, wording: str | None) -> None:
        out.setdefault(surface, Phrase(key, surface, form, wording))

    for light in LIGHT:
        for noun, tie, verb in HIDDEN:
            for article in (noun.split()[0], "the"):
                rest = f"{article} {noun.split()[1]} {tie}"
                plain = verb_forms(verb)
                for form, x in verb_forms(light).items():
                    add(f"{light} {rest}", f"{x} {rest}", form, plain[form])
    for adjective in MANNERS:
        article = "an" if adjective[0] in "aeiou" else "a"
        for noun in ("manner", "way", "fashion"):
            add(f"in {article} {adjective} {noun}", f"in {article} {adjective} {noun}", "base", adverb(adjective))
        add(f"of {article} {adjective} nature", f"of {article} {adjective} nature", "base", adjective)
    for amount, plain in AMOUNTS.items():
        add(f"a {amount} of", f"a {amount} of", "base", plain)
    for name in ("wordy_phrase", "filler", "cliche"):
        for phrase, plain in LEXICONS[name].items():
            add(phrase, phrase, "base", plain)
    return list(out.values())


PIECE = re.compile(r"[\w-]+|['’]|\s+|[^\w\s'’-]")
Trie = dict


def pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """(as the trie has it, start, end) of every piece."""
    for m in PIECE.finditer(text):
        x = m.group()
        yield " " if x.isspace() else "'" if x == "’" else x.lower(), m.start(), m.end()


def build_trie(phrases: list[Phrase]) -> Trie:
    root: Trie = {}
    for i, p in enumerate(phrases):
        node = root
        for x, _, _ in pieces(p.surface):
            node = node.setdefault(x, {})
        node[None] = i
    return root


WORD = re.compile(r"[\w-]+")


def matches(text: str, trie: Trie) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the phrase), leftmost and longest. Only words that start a phrase are walked on from."""
    starts = WORD if all(WORD.fullmatch(x) for x in trie if x) else PIECE
    at = 0
    while True:
        for m in starts.finditer(text, at):
            if (node := trie.get(m[0].lower())) is not None or starts is PIECE:
                break
        else:
            return
        stop, found = m.start(), None
        while step := PIECE.match(text, stop):
            x = step[0]
            node = (trie if stop == m.start() else node).get(" " if x.isspace() else "'" if x == "’" else x.lower())
            if node is None:
                break
            stop = step.end()
            if None in node:
                found = stop, node[None]
        if found:
            yield m.start(), *found
        at = found[0] if found else m.end()


def render(wording: str | None, surface: str) -> str | None:
    """The wording in capitals where the surface is, with one where the surface starts with one."""
    if not wording:
        return wording
    if surface == surface.upper() and sum(c.isalpha() for c in surface) > 1:
        return wording.upper()
    return wording[0].upper() + wording[1:] if surface[0].isupper() else wording


SCHEMA = "_row long, doc_id long, start long, end long, phrase string, form string, surface string, wording string"
#: Rows per block that leaves a task.
BLOCK = 8192


def find_phrases(docs: DataFrame, phrases: list[Phrase] | None = None, text: str = "text") -> DataFrame:
    """_row, doc_id, start, end, phrase (its base form), form, surface, wording of every match. Works within a row: no shuffle.

    The phrases travel with the task, so their number is bounded by what the caller hands over (the rules give some 3,000 surfaces).
    """
    table = build_phrases() if phrases is None else list(phrases)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 4

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = build_trie(table)
        block: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*block))
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for row, doc, value in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for start, end, i in matches(value, trie):
                    p, surface = table[i], value[start:end]
                    block.append((row, doc, start, end, p.key, p.form, surface, render(p.wording, surface)))
                    if len(block) == BLOCK:
                        yield flush()
        if block:
            yield flush()

    rows = docs.where(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("_t"))
    return rows.mapInArrow(find, SCHEMA)


def phrase_savings(found: DataFrame) -> DataFrame:
    """doc_id, phrase, n (matches), n_forms, saved (characters that the plainer wordings save; 0 where there is none)."""
    saved = F.when(F.col("wording").isNotNull(), F.col("end") - F.col("start") - F.length("wording")).otherwise(0)
    return found.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"), F.count_distinct("form").alias("n_forms"), F.sum(saved).cast("long").alias("saved"))
