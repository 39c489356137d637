"""Sections by offset: headings found as spans, and as-of look-ups of the section that an offset lies in.

Offsets and headings of a text are merged in one sorted pass, so a text of many headings and many offsets makes no pairs. What
lies before the first known heading is `body`; a heading's line belongs to the section that it opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .reports import SECTIONS, section_of

#: A line that holds a known section name alone, with a number before it or a colon behind it; the line break before it belongs to it.
HEADING_LINE = r"(?:^|\n)[ \t]*(?:[0-9]+(?:\.[0-9]+)*[.)]?[ \t]+)?(?i:" + "|".join(sorted(SECTIONS, key=lambda n: (-len(n), n))) + r")[: \t\r]*(?=\n|\z)"
#: What a document's issues leave out.
OUTSIDE = "references"


def heading_name(surface: Column) -> Column:
    """The section that a match of HEADING_LINE opens."""
    return section_of(F.regexp_replace(surface, r"^\s+", ""))


def section_at(points: DataFrame, headings: DataFrame, key: str = "doc_id") -> DataFrame:
    """points (key, start, ...) with the section that start lies in: of the last heading (key, start, name) at or before it.

    A null key is a text of its own. Of headings at one place the last name in order counts.
    """
    both = points.select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.struct(*points.columns).alias("_p"), F.lit(None).cast("string").alias("_name"))
    both = both.unionByName(headings.select(F.col(key).alias("_k"), F.col("start").alias("_at"), F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), F.col("name").alias("_name")))
    order = Window.partitionBy("_k").orderBy("_at", F.col("_p").isNotNull(), "_name").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("section", F.coalesce(F.last("_name", ignorenulls=True).over(order), F.lit("body")))
    return found.where("_p is not null").select("_p.*", "section")
