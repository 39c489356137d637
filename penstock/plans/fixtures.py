"""Tables for rules that the corpus does not trigger by itself: literal rows for the hard cases, and rows derived from the given tables.

Both come the same in Spark and in SQL. Derived rows read the whole of their tables; their ids start at 1000, above those of the literal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import DERIVED, DERIVED_PAIRS, tables_in
from ..sources.tables import read_table

SQL_TYPES = {"long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


class Fixture:
    """Rows with a Spark schema ("a long, b string") and a SQL common table expression of the same; with sf_dir also the derived rows."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [c.split(" ") for c in schema.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        own = spark.createDataFrame(self.rows, self.schema)
        if sf_dir is None:
            return own
        if self.name in DERIVED_PAIRS:
            more = DERIVED_PAIRS[self.name][0](spark, sf_dir)
        elif self.name in DERIVED:
            sql = DERIVED[self.name]
            more = spark.sql(sql, **{t: read_table(spark, f"{sf_dir}/{t}.parquet") for t in tables_in(sql)})
        else:
            return own
        more = more.toDF(*(c for c, _ in self.columns))
        return own.unionByName(more.select(*(F.col(c).cast(t).alias(c) for c, t in self.columns)))

    def cte(self) -> str:
        def literal(v):
            if v is None:
                return "NULL"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return str(v)

        rows = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in self.rows)
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        typed = ", ".join(f'"{c}"::{SQL_TYPES[t]} AS "{c}"' for c, t in self.columns)
        out = f"SELECT {typed} FROM (VALUES {rows}) v({names})"
        if self.name in DERIVED_PAIRS:
            out += f" UNION ALL SELECT {typed} FROM ({DERIVED_PAIRS[self.name][1]}) v({names})"
        elif self.name in DERIVED:
            sql = DERIVED[self.name]
            out += f" UNION ALL SELECT {typed} FROM ({sql.format(**{t: t for t in tables_in(sql)})}) v({names})"
        return f"{self.name} AS ({out})"


SPANS = Fixture("fx_spans", "doc_id long, start long, end long, kind string", [
    (1, 0, 5, "quote"), (1, 5, 9, "url"), (1, 8, 14, "number"), (1, 20, 30, "keep"), (1, 22, 25, "number"), (1, 30, 30, "term"), (1, 40, 41, "code"),
    (2, 3, 8, "number"), (2, 3, 8, "quote"), (2, 7, 12, "citation"), (2, 12, 15, "url"), (3, 0, 2, "term"), (3, 4, 6, "term"),
])
WINDOWS = Fixture("fx_windows", "doc_id long, window_id long, start long, end long", [(1, 1, 2, 10), (1, 2, 24, 35), (2, 1, 0, 4), (2, 2, 11, 13), (3, 1, 2, 4), (4, 1, 0, 9)])
EDIT_DOCS = Fixture("fx_edit_docs", "doc_id long, text string", [(1, "the quick brown fox jumps"), (2, "one two three"), (3, "overlap here"), (4, "no edits")])
EDITS = Fixture("fx_edits", "doc_id long, start long, end long, replacement string", [(1, 0, 3, "A"), (1, 10, 15, "reddish"), (1, 25, 25, " over"), (2, 4, 8, ""), (3, 0, 7, "x"), (3, 5, 9, "y")])
OFFSETS = Fixture("fx_offsets", "doc_id long, pos long", [(1, 0), (1, 2), (1, 4), (1, 12), (1, 16), (1, 25), (2, 4), (2, 6), (2, 9), (3, 2), (3, 8), (4, 3)])
ISSUES = Fixture("fx_issues", "doc_id long, rule string, start long, end long", [
    (1, "wordy_phrase", 0, 12), (1, "filler", 0, 12), (1, "filler", 3, 6), (1, "long_sentence", 0, 80), (1, "cliche", 20, 30), (1, "hedge", 22, 26), (1, "cliche", 50, 60), (1, "stock_phrase", 45, 65), (2, "hedge", 1, 5), (2, "weak_verb", 1, 5), (2, "wordy_phrase", 0, 4),
])
SENTENCES = Fixture("fx_sentences", "doc_id long, sent_idx long, section string, sentence string", [
    (1, 0, "introduction", "It is often said that many studies prove this in order to help."), (1, 1, "introduction", "Due to the fact that things change, results may possibly vary."), (1, 2, "results", "Clearly the pump is the best device of all."), (1, 3, "results", "It gave 45 W at 3 bar (Smith, 2019)."),
    (1, 4, "results", "The flow was very steady."), (1, 5, "results", "The valve was quite stiff."), (1, 6, "results", "The hose was rather old."), (1, 7, "conclusion", "We believe that this will always work."), (2, 0, "body", "In my view the test was fair."), (2, 1, "body", "Research shows that practice helps."), (2, 2, "body", "For example, 12 people improved."),
    (2, 3, "body", "There are some parts that are worn."), (2, 4, "body", "This is not a toy, but a tool."), (3, 0, "methodology", "A lot of time was spent - too much - on it."), (3, 1, "methodology", "It goes without saying that we don't know."), (3, 2, "methodology", "Perhaps it might seem likely to fail."),
])
REPORT = Fixture("fx_report", "doc_id long, line_idx long, line string", [
    (1, 0, "Abstract"), (1, 1, "The HVAC unit was tested."), (1, 2, "1. Introduction"), (1, 3, "A finite element method (FEM) was used. FEM is fast. The CPU ran at 5kg and 20 Kgs."), (1, 4, "2. Methodology"), (1, 5, "See Figure 1 and Figure 3. Mass 12 kg, length 3 ft, span 2 m."), (1, 6, "Figure 1: The rig"), (1, 7, "Figure 2: The pump"), (1, 8, "3. Results"),
    (1, 9, "The particle image method (PIM) gave 30 degC."), (1, 10, "Table 2: Loads"), (1, 11, "Table 4: More loads"), (1, 12, "Conclusion"), (1, 13, "FEM and Table 2 agree."), (2, 0, "Results"), (2, 1, "Only 7 mm here."), (2, 2, "Introduction"), (2, 3, "The finite volume method (FVM) (FVM) is FVM."),
])
ANSWERS = Fixture("fx_answers", "qid long, answer string, key string", [
    (1, "The Turbine", "turbine"), (2, "turbin", "turbine"), (3, "pump", "pmp"), (4, "", "pump"), (5, "heat exchangr", "heat exchanger"), (6, "heat", "heat exchanger"), (7, "An  orifice-plate!", "orifice-plate"), (8, "valve", "valves"), (9, "throtle", "throttle"), (10, None, "x"),
])
OPEN_ANSWERS = Fixture("fx_open", "qid long, answer string, source string, concepts string", [
    (1, "The pump moves water and the valve stops it when pressure is high", "The pump moves water through the pipe and the valve stops it when pressure is high.", "pump|valve|pressure"), (2, "water moves", "The pump moves water.", "pump|water"), (3, "My own idea is that a pump adds energy", "The pump moves water through the pipe.", "pump|energy|pipe"), (4, "it is a thing we saw", "Heat flows from hot to cold.", "heat|cold"), (5, "heat goes from the hot side over to the cold side", "Heat flows from hot to cold.", ""),
])
ORIGINS = Fixture("fx_origins", "doc_id long, origin string, text string", [(1, "student_insert", "I wrote this bit."), (1, "ai", "Generated words here"), (1, "student_edit", "half mine"), (1, None, "untagged"), (1, "engine", "swapped"), (2, "ai", "all made"), (3, "student_insert", "mine only")])
PROGRESS = Fixture("fx_progress", "doc_id long, offered int, decided int, spots int, filled int, paragraphs int, got int, marked int, quiz double, teach double", [(1, 10, 8, 4, 3, 6, 5, 6, 80.0, 60.0), (2, 0, 0, 0, 0, 4, 4, 4, None, 40.0), (3, 5, 5, 2, 0, 0, 0, 0, 70.0, None), (4, 3, 0, 1, 1, 5, 1, 2, None, None)])
VIVA = Fixture("fx_viva", "doc_id long, level int, score double, concept string", [(1, 1, 90.0, "pump"), (1, 1, 60.0, "Valve"), (1, 2, 75.0, "pump"), (1, 3, 30.0, "valve"), (1, 3, 20.0, "heat"), (2, 1, 10.0, "heat"), (2, 2, 95.0, "flow")])
REVIEWS = Fixture("fx_reviews", "card_id long, at_min double, grade int", [(1, 0.0, 3), (1, 1500.0, 3), (1, 12000.0, 4), (1, 40000.0, 1), (1, 40020.0, 3), (2, 10.0, 1), (2, 30.0, 1), (2, 60.0, 2), (2, 3000.0, 2), (2, 12000.0, 2), (3, 5.0, 4)])
WORDS_A = Fixture("fx_words", "word string", [("apple",), ("hour",), ("university",), ("NASA",), ("UFO",), ("MRI",), ("one",), ("European",), ("umbrella",), ("Heir",), ("GUI",), ("user",)])
LM_CORPUS = Fixture("fx_lm", "doc_id long, text string", [(1, "the pump moves water"), (2, "the pump stops"), (3, "the water moves the pump"), (4, "a valve stops 12 litres")])
LM_TESTS = Fixture("fx_lm_tests", "id long, text string", [(1, "the pump moves"), (2, "the valve moves water"), (3, "unknown words stops")])
