"""Text as relations: paragraphs, sentences, words and pattern matches with offsets, all as column expressions.

Offsets are half-open and count Unicode code points. A sentence ends after [.!?] where white space and a capital, quote or
bracket follow; words are ASCII letters with inner apostrophes and hyphens. These are the parse-free definitions that all
metrics of this library share.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks a sentence break between two captured neighbours.
BREAK = "\u0001"
#: What ends a sentence, what a word is, and the tokens of the language model.
SENTENCE_END = r'([.!?])\s+([A-Z"“(])'
WORD = r"[A-Za-z][A-Za-z'’-]*"
LM_TOKEN = r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:[.,][0-9]+)*|[^\sa-z0-9]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def match_count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def normalise(text: Column) -> Column:
    """CRLF to LF, no-break spaces to spaces, no trailing blanks, one blank line at most, trimmed."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.regexp_replace(t, " ", " ")
    t = F.regexp_replace(t, "[ \t]+\n", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def title_guess(text: Column, most: int = 70) -> Column:
    """The first line with something on it, trimmed and cut."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, most)


def is_title_line(text: Column) -> Column:
    """One line of at most 14 words without a closing stop."""
    t = F.trim(text)
    return (t != "") & ~t.contains("\n") & (F.size(F.split(t, r"\s+")) <= 14) & ~t.rlike(r"[.!?;:]$")


#: The most characters and words of a heading, of one in capitals and of one in title case, and the least share of capitals there.
HEADING = {"characters": 90, "words": 10, "colon_words": 6, "capitals_words": 8, "title_words": 6, "title_share": 0.6}


def heading_style(line: Column) -> Column:
    """How a line is set as a heading (mark, number, capitals, title), or null: what its first word, its last sign and its words' initials say."""

    def of(w: Column) -> Column:
        n, first, second = F.size(w), F.get(w, F.lit(0)), F.get(w, F.lit(1))
        last = F.right(F.get(w, n - 1), F.lit(1))
        initials = F.transform(w, lambda x: F.left(x, F.lit(1)).between("A", "Z").cast("int"))
        capitals = F.aggregate(initials, F.lit(0), lambda a, x: a + x)
        open_ended = (n <= HEADING["words"]) & ~last.isin(".", "?", "!", ",", ";") & ((last != ":") | (n <= HEADING["colon_words"]))
        joined = F.array_join(w, " ")
        style = (
            F.when(first.startswith("#"), "mark")
            .when(~open_ended, None)
            .when(first.rlike(r"^([0-9]+(\.[0-9]+)*|[IVX]+)[.)]?$") & F.left(second, F.lit(1)).between("A", "Z"), "number")
            .when((n <= HEADING["capitals_words"]) & (joined == F.upper(joined)) & joined.rlike("[A-Z]"), "capitals")
            .when((n <= HEADING["title_words"]) & (capitals >= 1) & (capitals >= HEADING["title_share"] * n), "title")
        )
        return F.when(n > 0, style)

    return F.when(F.length(F.trim(line)) <= HEADING["characters"], let(F.filter(F.split(F.trim(line), r"\s+"), lambda x: x != ""), of))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, para_idx, start, end, para_text: blocks between blank lines, or lines where a text has no blank line.

    Trimmed; empty ones are not counted. Offsets are running sums over the blocks of a row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blocks = F.when(t.rlike(r"\n[ \t]*\n"), F.split(F.regexp_replace(t, r"(\n[ \t]*\n)", "$1\u0002"), "\u0002")).otherwise(
        F.split(F.regexp_replace(t, "(\n)", "$1\u0002"), "\u0002")
    )
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", blocks.alias("_b")).select("_row", "doc_id", F.posexplode("_b").alias("_k", "t"))
    order = Window.partitionBy("_row").orderBy("_k")
    rows = rows.withColumn("at", F.sum(F.length("t")).over(order) - F.length("t")).where(F.col("t").rlike(r"\S"))
    bare = F.regexp_replace("t", r"^\s+", "")
    return (
        rows.withColumn("para_idx", (F.row_number().over(order) - 1).cast("long"))
        .select("doc_id", "para_idx", (F.col("at") + F.length("t") - F.length(bare)).cast("long").alias("start"), F.regexp_replace(bare, r"\s+$", "").alias("para_text"))
        .withColumn("end", F.col("start") + F.length("para_text"))
        .select("doc_id", "para_idx", "start", "end", "para_text")
    )


def sentence_list(text: Column) -> Column:
    return F.split(F.regexp_replace(text, SENTENCE_END, f"$1{BREAK}$2"), BREAK)


def sentence_array(text: Column) -> Column:
    """Array of (para_idx, sentence) of the sentences with a word; a line is a paragraph."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    per_line = F.transform(lines, lambda x, i: F.transform(sentence_list(x), lambda y: F.struct(i.cast("long").alias("para_idx"), F.trim(y).alias("sentence"))))
    return F.filter(F.flatten(per_line), lambda x: x["sentence"].rlike("[A-Za-z]"))


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    """_row, doc_id, sent_idx, para_idx, sentence, words, n_words: all from a document's own row, without a shuffle.

    _row numbers the documents: rows may share an id or have none.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", sentence_array(F.col(text)).alias("_s"))
    rows = rows.select("_row", "doc_id", F.posexplode("_s").alias("sent_idx", "s"))
    rows = rows.select("_row", "doc_id", F.col("sent_idx").cast("long"), "s.para_idx", "s.sentence").withColumn("words", word_list(F.col("sentence")))
    return rows.withColumn("n_words", F.size("words").cast("long"))


def own_text(rows: DataFrame) -> list[str]:
    """What tells texts apart in windows and groups: the number of the row where there is one, and the id."""
    return ["_row", "doc_id"] if "_row" in rows.columns else ["doc_id"]


def lm_tokens(text: Column) -> Column:
    """Lower-case words, numbers as <num>, single symbols."""
    found = F.regexp_extract_all(F.lower(text), F.lit(LM_TOKEN), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike("^[0-9]"), F.lit("<num>")).otherwise(x))


def find_spans(docs: DataFrame, patterns: dict[str, str], text: str = "text", keep: tuple[str, ...] = (), needs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, kind, start, end, surface of every match of each pattern; with keep ("_row",) also a number of the row.

    Spark has no finditer: one pass puts a sign around each match, so what stands between signs is gap and match in turn, and a running
    sum of their lengths places them. A text that has the sign itself takes what split() leaves and regexp_extract_all() finds, three passes.
    needs: signs of which every match of a kind has one; a text without them is not searched. Patterns must not match the empty string.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<kind:string,gap:int,surface:string>>")

    def pair(kind: str, gap: Column, surface: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), surface.alias("surface"))

    def alternating(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        slow = F.zip_with(F.slice(F.split(t, pattern, -1), 1, F.size(found)), found, lambda g, m: pair(kind, g, m))
        paired = lambda p: F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), lambda k: pair(kind, F.get(p, k - 1), F.get(p, k)))).otherwise(none)
        fast = let(F.split(F.regexp_replace(t, pattern, f"{BREAK}$0{BREAK}"), BREAK, -1), paired)
        hope = [t.contains(sign) for sign in (needs or {}).get(kind, ())]
        out = F.when(t.contains(BREAK), slow)
        return (out.when(reduce(or_, hope), fast) if hope else out.when(F.lit(True), fast)).otherwise(none)

    pairs = F.concat(*[alternating(kind, pattern) for kind, pattern in patterns.items()])
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", pairs.alias("_p"))
    rows = rows.select("_row", "doc_id", F.posexplode("_p").alias("_k", "s")).select("_row", "_k", "doc_id", "s.*")
    end = F.sum(F.col("gap") + F.length("surface")).over(Window.partitionBy("_row", "kind").orderBy("_k"))
    # One exchange by row serves the running sums; spans are a few dozen bytes each.
    placed = rows.repartition("_row").withColumn("end", end.cast("long"))
    return placed.select(*keep, "doc_id", "kind", (F.col("end") - F.length("surface")).cast("long").alias("start"), "end", "surface")
