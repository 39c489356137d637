"""Checks of technical reports, on lines (doc_id, line_idx, line): sections, abbreviations, figures, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Our section names by alias, and the usual order.
SECTIONS = {"abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "introduction", "methodology": "methodology", "methods": "methodology", "results": "results", "discussion": "discussion", "conclusion": "conclusion", "conclusions": "conclusion", "references": "references"}
ORDER = ["abstract", "introduction", "methodology", "results", "discussion", "conclusion", "references"]
REQUIRED = ["abstract", "introduction", "methodology", "results", "conclusion"]
#: Unit symbols with their quantity and whether they are SI; spellings that are wrong with the right one.
UNITS = {"kg": ("mass", True), "g": ("mass", True), "lb": ("mass", False), "m": ("length", True), "mm": ("length", True), "ft": ("length", False), "in": ("length", False), "s": ("time", True)}
WRONG_UNITS = {"Kg": "kg", "Kgs": "kg", "kgs": "kg", "mtr": "m", "secs": "s", "sec": "s"}


def section_of(line: Column) -> Column:
    """The canonical section of a heading line, or null."""
    name = F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, r"^\s*[0-9]+(?:\.[0-9]+)*[.)]?\s+", ""), r"[:\s]+$", "")))
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return table[name]


def sections(lines: DataFrame) -> DataFrame:
    """doc_id, name, first_line, last_line: from a known heading to the next; what comes before is `body`."""
    heads = lines.select("doc_id", "line_idx", section_of(F.col("line")).alias("name")).where("name is not null")
    ends = lines.groupBy("doc_id").agg(F.max("line_idx").alias("last"), F.min("line_idx").alias("first"))
    order = Window.partitionBy("doc_id").orderBy("line_idx")
    own = heads.withColumn("_next", F.lead("line_idx").over(order)).join(ends, "doc_id").select("doc_id", "name", F.col("line_idx").alias("first_line"), F.coalesce(F.col("_next") - 1, F.col("last")).alias("last_line"))
    first = heads.groupBy("doc_id").agg(F.min("line_idx").alias("_h"))
    body = ends.join(first, "doc_id", "left").where("_h is null or _h > first").select("doc_id", F.lit("body").alias("name"), F.col("first").alias("first_line"), F.coalesce(F.col("_h") - 1, F.col("last")).alias("last_line"))
    return own.unionByName(body)


def structure_issues(lines: DataFrame) -> DataFrame:
    """doc_id, rule, section: required sections that lack, and sections behind one that should follow them."""
    heads = lines.select("doc_id", "line_idx", section_of(F.col("line")).alias("section")).where("section is not null")
    several = heads.groupBy("doc_id").agg(F.countDistinct("section").alias("k")).where("k >= 2").select("doc_id")
    needed = several.select("doc_id", F.explode(F.array(*[F.lit(x) for x in REQUIRED])).alias("section"))
    missing = needed.join(heads, ["doc_id", "section"], "left_anti").select("doc_id", F.lit("structure.missing").alias("rule"), "section")
    place = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col("section"))
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    late = heads.withColumn("_p", place).withColumn("_max", F.max("_p").over(before)).where("_p < _max").select("doc_id", F.lit("structure.order").alias("rule"), "section")
    return missing.unionByName(late)


def abbreviations(lines: DataFrame) -> DataFrame:
    """doc_id, rule, abbr: used before or without a definition, defined again, defined and never used after."""
    defined = lines.select("doc_id", "line_idx", F.explode(F.regexp_extract_all("line", F.lit(r"[a-z]+ \(([A-Z]{2,6})\)"), F.lit(1))).alias("abbr"))
    used = lines.select("doc_id", "line_idx", F.explode(F.regexp_extract_all(F.regexp_replace("line", r"\([A-Z]{2,6}\)", "()"), F.lit(r"\b([A-Z]{2,6})\b"), F.lit(1))).alias("abbr"))
    d = defined.groupBy("doc_id", "abbr").agg(F.min("line_idx").alias("def_line"))
    u = used.groupBy("doc_id", "abbr").agg(F.min("line_idx").alias("first_use"), F.max("line_idx").alias("last_use"))
    both = d.join(u, ["doc_id", "abbr"], "full")
    undefined = both.where("first_use is not null and (def_line is null or first_use < def_line)").select("doc_id", F.lit("abbr.undefined").alias("rule"), "abbr")
    unused = both.where("def_line is not null and (last_use is null or last_use < def_line)").select("doc_id", F.lit("abbr.unused").alias("rule"), "abbr")
    marks = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"\(([A-Z]{2,6})\)"), F.lit(1))).alias("abbr")).groupBy("doc_id", "abbr").agg(F.count("*").alias("n"))
    again = marks.where("n > 1").select("doc_id", F.lit("abbr.redefined").alias("rule"), "abbr")
    return undefined.unionByName(unused).unionByName(again)


def figures(lines: DataFrame) -> DataFrame:
    """doc_id, rule, kind, number: captions nobody mentions, mentions without caption, gaps in the captions' numbers."""
    caption = r"^(Figure|Table) ([0-9]+):"
    captions = lines.where(F.col("line").rlike(caption)).select("doc_id", F.regexp_extract("line", caption, 1).alias("kind"), F.regexp_extract("line", caption, 2).cast("long").alias("number"))
    text = lines.where(~F.col("line").rlike(caption)).select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(r"(?:Figure|Table) [0-9]+"), F.lit(0))).alias("m"))
    mentions = text.select("doc_id", F.split("m", " ")[0].alias("kind"), F.split("m", " ")[1].cast("long").alias("number")).distinct()
    key = ["doc_id", "kind", "number"]
    gap = captions.withColumn("_p", F.lag("number").over(Window.partitionBy("doc_id", "kind").orderBy("number"))).where("number - _p > 1").select(*key)
    named = lambda df, rule: df.select("doc_id", F.lit(rule).alias("rule"), "kind", "number")
    return named(captions.join(mentions, key, "left_anti"), "figures.unreferenced").unionByName(named(mentions.join(captions, key, "left_anti"), "figures.missing")).unionByName(named(gap, "figures.gap"))


def units(lines: DataFrame) -> DataFrame:
    """doc_id, rule, surface, suggestion: wrong symbols, no space after the number, quantities in SI and other units."""
    symbols = "|".join(sorted([*UNITS, *WRONG_UNITS], key=lambda x: (-len(x), x)))
    found = lines.select("doc_id", F.explode(F.regexp_extract_all("line", F.lit(rf"[0-9]+(?:\.[0-9]+)?\s?(?:{symbols})\b"), F.lit(0))).alias("surface"))
    found = found.select("doc_id", "surface", F.regexp_extract("surface", r"^[0-9.]+", 0).alias("number"), F.regexp_extract("surface", r"[A-Za-z]+$", 0).alias("unit"))
    right = F.create_map(*[F.lit(x) for kv in WRONG_UNITS.items() for x in kv])[F.col("unit")]
    case = found.where(right.isNotNull()).select("doc_id", F.lit("units.symbol").alias("rule"), "surface", F.concat_ws(" ", "number", right).alias("suggestion"))
    space = found.where(~F.col("surface").rlike(r"\s") & right.isNull()).select("doc_id", F.lit("units.spacing").alias("rule"), "surface", F.concat_ws(" ", "number", "unit").alias("suggestion"))
    quantity = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[0])])[F.col("unit")]
    si = F.create_map(*[F.lit(x) for k, v in UNITS.items() for x in (k, v[1])])[F.col("unit")]
    kinds = found.select("doc_id", quantity.alias("q"), si.alias("si")).where("q is not null").groupBy("doc_id", "q").agg(F.countDistinct("si").alias("n"))
    mixed = kinds.where("n = 2").select("doc_id", F.lit("units.mixed").alias("rule"), F.col("q").alias("surface"), F.lit(None).cast("string").alias("suggestion"))
    return case.unionByName(space).unionByName(mixed)
