"""Sections at offsets against a plain scan of the headings."""

import random

from pyspark.sql import functions as F

from penstock.functions.text import find_spans
from penstock.operators import detectors as D
from penstock.operators import sections as S

TEXT = "It is very long.\n1. Introduction\nThis is very short.\nMethods:\nA very good rule.\n2 Results and very much\nReferences\nVery old book.\nConclusion\nVery well.\n  discussion  \nvery"


def test_headings(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "references"), (3, None), (4, ""), (5, "Results\r\nResults\n\nRESULTS:"), (6, "The results\nResults show")], "doc_id long, text string")
    got = find_spans(docs, {"h": S.HEADING_LINE}).withColumn("name", S.heading_name(F.col("surface"))).collect()
    names = {d: [r.name for r in sorted(got, key=lambda r: r.start) if r.doc_id == d] for d in range(1, 7)}
    assert names == {1: ["introduction", "methodology", "references", "conclusion", "discussion"], 2: ["references"], 3: [], 4: [], 5: ["results"] * 3, 6: []}


def test_section_at_equals_a_scan(spark):
    rng = random.Random(5)
    heads = [(rng.choice([1, 2, 3, None]), rng.randrange(0, 60), rng.choice("abc")) for _ in range(40)]
    points = [(rng.choice([1, 2, 3, 4, None]), rng.randrange(0, 70), i) for i in range(200)]
    got = S.section_at(spark.createDataFrame(points, "doc_id long, start long, section_no long"), spark.createDataFrame(heads, "doc_id long, start long, name string")).collect()

    def plain(doc, at):
        before = [(s, n) for d, s, n in heads if d == doc and s <= at]
        return max(before)[1] if before else "body"

    assert sorted((r.section_no, r.section) for r in got) == [(i, plain(d, at)) for d, at, i in points]


def test_body_issues_lie_outside_headings_and_references(spark):
    docs = spark.createDataFrame([(7, TEXT), (7, TEXT), (None, "References\nIt is very old."), (8, None), (9, "")], "doc_id long, text string")
    got = D.phrase_issues(docs, body=True).where("rule = 'filler'").collect()
    assert len({r._row for r in got}) == 2 and {r.doc_id for r in got} == {7}
    own = sorted((r.start, r.section) for r in got if r._row == got[0]._row)
    assert [s for _, s in own] == ["body", "introduction", "methodology", "methodology", "conclusion", "discussion"]
    assert all(TEXT[a : a + 4].lower() == "very" for a, _ in own)
    every = D.phrase_issues(docs).where("rule = 'filler'").count()
    assert every == 2 * 7 + 1
    assert D.analyse(docs, body=True).where("rule = 'filler'").count() == 12


def test_a_heading_is_no_issue(spark):
    docs = spark.createDataFrame([(1, "Summary\nIt is very odd.\nSummary")], "doc_id long, text string")
    assert [(r.start, r.section) for r in D.phrase_issues(docs, body=True).where("rule = 'filler'").collect()] == [(14, "abstract")]
