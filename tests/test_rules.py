"""Fire and must-not-fire pairs of rules, graphs and rewrites."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penstock.functions import text as T
from penstock.functions.text import word_list
from penstock.operators import graph as G
from penstock.operators import issues as I
from penstock.operators import reports as P
from penstock.operators import rewriting as W
from penstock.operators.reviews import current_streak


def sentences(spark, *texts):
    df = spark.createDataFrame([(1, k, "body", t) for k, t in enumerate(texts)], "doc_id long, sent_idx long, section string, sentence string")
    return df.withColumn("words", word_list(F.col("sentence"))).withColumn("n_words", F.size("words").cast("long"))


def test_lexicon_whole_words_longest_first(spark):
    s = sentences(spark, "In order to try, very well.", "Every disorder told us.", "Due to the fact that a lot of it ran.", "VERY loud.")
    got = sorted((r.sent_idx, r.phrase) for r in I.lexicon_hits(s).collect())
    assert got == [(0, "in order to"), (0, "very"), (2, "a lot of"), (2, "due to the fact that"), (3, "very")]


def test_claims_need_evidence_here_or_next(spark):
    s = sentences(spark, "This proves it.", "No more.", "It always works.", "See 12 runs.", "It never fails [3].")
    assert [r.sent_idx for r in I.unsupported_claims(s).collect()] == [0]


@pytest.mark.parametrize("line,hit", [("# Title", True), ("2.1 Method Used", True), ("ALL CAPS LINE", True), ("Plain sentence here with words.", False), ("A Title Case Line", True), ("", False), ("x" * 91, False)])
def test_headings(spark, line, hit):
    assert spark.createDataFrame([(line,)], "l string").select(T.heading_style(F.col("l")).isNotNull().alias("h")).first().h == hit


def test_units(spark):
    lines = spark.createDataFrame([(1, 0, "Mass 5kg, 3 kg and 2 kgs; in 12 ways; 7 ft or 2 m."), (2, 0, "Only 5 kg.")], "doc_id long, line_idx long, line string")
    got = {(r.doc_id, r.rule, r.surface, r.suggestion) for r in P.units(lines).collect()}
    assert got >= {(1, "units.spacing", "5kg", "5 kg"), (1, "units.symbol", "2 kgs", "2 kg"), (1, "units.mixed", "length", None)}
    assert not any(d == 2 for d, *_ in got)


def test_rewrites_leave_clean_sentences(spark):
    s = sentences(spark, "The pump runs.", "We don't know in order to see.", "It ran - as planned - well.")
    got = {(r.sent_idx, r.transform): r.text for r in W.candidates(s).collect()}
    assert not any(k == 0 for k, _ in got)
    assert got[1, "all"] == "We do not know to see." and got[2, "dash_tidy"] == "It ran, as planned, well."


def test_pagerank():
    star = np.zeros((4, 4))
    star[0, 1:] = star[1:, 0] = 1
    r = G.pagerank(star)
    assert r.sum() == pytest.approx(1) and r[0] == max(r) and r[1] == pytest.approx(r[2])
    assert G.pagerank(np.zeros((3, 3))) == pytest.approx([1 / 3] * 3)


def test_central_sentence(spark):
    s = sentences(spark, "the pump moves water", "the pump moves water fast", "water moves the pump", "unrelated words only")
    got = {r.sent_idx: r.rank for r in G.central_sentences(s).collect()}
    assert min(got, key=got.get) == 3 and max(got.values()) == 1.0


def test_current_streak(spark):
    rows = [(1, d) for d in ("2024-01-03", "2024-01-04", "2024-01-05")] + [(2, "2024-01-01"), (3, "2024-01-04"), (3, "2024-01-02")]
    df = spark.createDataFrame(rows, "user_id long, d string").select("user_id", F.to_timestamp("d").alias("ts"))
    assert dict(current_streak(df, "2024-01-05").collect()) == {1: 3, 2: 0, 3: 1}
