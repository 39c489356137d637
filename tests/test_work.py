"""Costly work is done once: what the optimised plan holds, and that the rows are those of plain Python."""

import re

from pyspark.sql import functions as F

from penstock.functions.text import WORD, sentences
from penstock.operators import questions as Q
from penstock.operators import rewriting as W

DOCS = [(1, "Engineers measure pressure and measure temperature daily. Nothing here is long or odd at all. The the pressure rose."), (2, "Zürich machines Machines handle turbines turbines quickly now."), (3, None), (4, "")]


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_gaps_look_for_words_once(spark):
    s = sentences(spark.createDataFrame(DOCS, "doc_id long, text string"))
    rows = Q.gaps(s)
    assert plan(rows).count("regexp_extract_all") == 1
    want = set()
    for r in s.collect():
        words = re.findall(WORD, r.sentence)
        once = [w for w in words if len(w) >= 7 and [x.lower() for x in words].count(w.lower()) == 1]
        if 6 <= len(words) <= 45 and re.search(r"[.]\s*$", r.sentence) and once:
            want.add((r.doc_id, r.sent_idx, max(once, key=len)))
    assert {(r.doc_id, r.sent_idx, r.key) for r in rows.collect()} == want and len(want) >= 2


def test_candidates_make_each_rewrite_once(spark):
    texts = ["Due to the fact that it don't work, a lot of it is very old.", "Plain words only.", "It is - too much - really odd; don't.", "very", "A a lot of a lot of it.", None, ""]
    rows = W.candidates(spark.createDataFrame([(1, k, x) for k, x in enumerate(texts)], "doc_id long, sent_idx long, sentence string"))
    # Phrases, contractions and dashes, the last two also in the row of all; three in each tidying.
    assert plan(rows).count("regexp_replace") == 14 + 2 * len(W.EXPANSIONS) + 2 + 3 * 3
    got = {(r.sent_idx, r.transform): r.text for r in rows.collect()}
    assert got[0, "all"] == "Because it do not work, much it is old."
    assert got[2, "all"] == "It is, too much, odd; do not." and got[4, "phrase_simplify"] == "A much a lot of it."
    assert not {k for k, _ in got} & {1, 5, 6}


def test_a_glossary_looks_for_definitions_only_where_one_ends(spark):
    lines = [(1, 0, "A finite element method (FEM) was used, and FEM (fem) again."), (1, 1, "no definition " * 20), (2, 0, "heat-flux meter (HM)x and (AB)"), (2, 1, None), (3, 0, "(XY) alone")]
    rows = Q.glossary(spark.createDataFrame(lines, "doc_id long, line_idx long, line string"))
    assert {tuple(r) for r in rows.collect()} == {(1, "FEM", "finite element method"), (2, "HM", "heat-flux meter")}
    assert Q.BRACKETED in plan(rows).split("Filter")[-1]


def test_a_minimal_edit_compares_from_each_end_once(spark):
    from penstock.operators.editing import minimal_edit

    rows = spark.createDataFrame([("a b c d", "a x c d"), ("a", "a a"), ("", "x"), ("same", "same"), (None, "x")], "old string, new string").select(minimal_edit(F.col("old"), F.col("new")).alias("e"))
    assert plan(rows).count("zip_with") == 2
    assert [tuple(r.e) if r.e else None for r in rows.collect()] == [(2, 3, "x"), (1, 1, " a"), (0, 0, "x"), None, None]


def test_the_checks_of_a_report_make_its_lines_once(spark):
    from penstock.operators.services import report_issues

    lines = spark.createDataFrame([(1, 0, "Results"), (1, 1, "The mass was 5.")], "doc_id long, line_idx long, line string").where("line_idx >= 0")
    rows = report_issues(lines)
    assert "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString() and ("units.missing", "1") in {(r.rule, r.about) for r in rows.collect()}
