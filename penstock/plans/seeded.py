"""Documents with phrases that the rules look for, derived from the documents table: common words give way to phrases.

The invented corpus has no stock phrases, transitions, citations or contractions of its own. Every replacement is a literal one, the same in
Spark and in SQL, so all rows and all their texts take part and the work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: (what is replaced, by what), in this order.
SEEDS = [
    (". The ", ". However, the "),
    (". And ", ". Moreover, it seems that "),
    (". Of ", ". There are some parts that are worn. "),
    (". In ", ". In my view many studies show that "),
    (" with ", " due to the fact that "),
    (" by ", " in order to "),
    (" for ", " very "),
    (" from ", " with regard to "),
    (" on ", " - too much - "),
    (" as ", " (Smith, 2010) and 5 kg of "),
    (" are ", " don't make an analysis of "),
    (" this ", ' "in order to" '),
    (" is ", " is perhaps always "),
    (" it ", " it is likely that the FEM "),
]
#: Phrases in several forms, cases and spacings, and what only looks like one.
FORM_SEEDS = [
    (" of ", " made a comparison of "),
    (" de ", " takes  the measurement of "),
    (" the ", " don’t conduct an evaluation of the "),
    (" la ", " carrying out a\nreview of "),
    (" and ", " gave an answer to a large number of "),
    (" to ", " in a careful manner, "),
    (" in ", " make a study-of "),
    (" is ", " 'in order to' make make a test of "),
    (". A", ". PERFORMED AN INSPECTION OF A"),
    (". T", ". Undertaken a survey of it at the end of the day. T"),
]
#: The same with headings of sections, and a line that is none.
REPORT_SEEDS = [*SEEDS, (".\nT", ".\n3. Results\nT"), (".\nA", ".\nReferences:\nA"), (".\nI", ".\n Methods\nI"), (".\nE", ".\nVery\nE"), (".\nL", ".\nDISCUSSION \nL")]


def seeded(spark: SparkSession, sf_dir: str, seeds: list[tuple[str, str]] = SEEDS) -> DataFrame:
    text = F.col("text")
    for old, new in seeds:
        text = F.replace(text, F.lit(old), F.lit(new))
    return read_table(spark, f"{sf_dir}/documents.parquet").withColumn("text", text)


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def seeded_sql(name: str = "documents", seeds: list[tuple[str, str]] = SEEDS) -> str:
    """A common table expression that puts the seeded documents in the place of the table."""
    text = "text"
    for old, new in seeds:
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    return f"{name} AS (SELECT * REPLACE ({text} AS text) FROM main.documents)"
