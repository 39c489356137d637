"""Edits between versions of a text, greedy choice of spans, and finding a phrase again after edits."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let

HUNK = T.ArrayType(T.StructType([T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("replacement", T.StringType()))]))
#: Words with apostrophes, single marks, runs of white space.
DIFF_TOKEN = re.compile(r"\w+(?:['’]\w+)*|\s+|[^\w\s]")


def hunks(old: str, new: str) -> list[dict]:
    """Replacements of spans of old that give new, by words; hunks with only white space between are one."""
    a, b = DIFF_TOKEN.findall(old), DIFF_TOKEN.findall(new)
    at = [0]
    for t in a:
        at.append(at[-1] + len(t))
    out: list[dict] = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        text = "".join(b[j1:j2])
        if out and old[out[-1]["end"] : at[i1]].isspace():
            text = out[-1]["replacement"] + old[out[-1]["end"] : at[i1]] + text
            out[-1] |= {"end": at[i2], "replacement": text}
        else:
            out.append({"start": at[i1], "end": at[i2], "replacement": text})
    return out


@F.pandas_udf(HUNK)
def diff_hunks(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Hunks between two columns of text; null texts count as empty."""
    for old, new in pairs:
        yield pd.Series([hunks(a or "", b or "") for a, b in zip(old, new)])


def greedy_spans(spans: DataFrame) -> DataFrame:
    """doc_id, start, end: from the left, the longest span that begins where none chosen before covers; one group is one document."""
    log = spans.where("start < end").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg")))).alias("s"))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(a, x):
        end = -x["neg"]
        free = x["start"] >= a["at"]
        return F.struct(
            F.when(free, end).otherwise(a["at"]).alias("at"), F.when(free, F.concat(a["out"], F.array(F.struct(x["start"].alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out")
        )

    return log.select("doc_id", F.explode(F.aggregate("s", first, step, lambda a: a["out"])).alias("p")).select("doc_id", "p.*")


def nearest_occurrence(text: Column, phrase: Column, pos: Column, within: int = 400) -> Column:
    """Start of the occurrence of a phrase closest to a place, at most so far away; ties go to the left; null without one."""
    low = F.greatest(pos - within, F.lit(0)).cast("int")
    high = F.least(pos + within, F.length(text) - F.length(phrase)).cast("int")
    places = F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: text.substr(i + 1, F.length(phrase)) == phrase)
    best = F.array_min(F.transform(starts, lambda i: F.struct(F.abs(i - pos).alias("far"), i.alias("at"))))
    return F.when(F.length(phrase) > 0, best["at"]).cast("long")


def minimal_edit(old: Column, new: Column) -> Column:
    """(start, end, replacement): the least span of old to replace, in whole words; null where both are equal or either is null.

    Words and what stands between them are compared from both ends, so an edit never begins or ends inside a word.
    """
    parts = lambda t: F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"), F.lit(0))

    def of(p: Column) -> Column:
        a, b = p["a"], p["b"]
        most = F.least(F.size(a), F.size(b))
        differ = lambda x, y: F.array_position(F.zip_with(F.slice(x, 1, most), F.slice(y, 1, most), lambda u, v: u != v), True)
        head = lambda x, y: let(differ(x, y), lambda d: F.when(d == 0, most).otherwise(d.cast("int") - 1))
        joined = lambda x: F.array_join(x, "")
        span = lambda first, last: F.struct(
            F.length(joined(F.slice(a, 1, first))).cast("long").alias("start"),
            (F.length(joined(a)) - F.length(joined(F.slice(a, F.size(a) - last + 1, last)))).cast("long").alias("end"),
            joined(F.slice(b, first + 1, F.size(b) - last - first)).alias("replacement"),
        )
        return let(head(a, b), lambda first: let(F.least(head(F.reverse(a), F.reverse(b)), most - first), lambda last: span(first, last)))

    return F.when(old != new, let(F.struct(parts(old).alias("a"), parts(new).alias("b")), of))
