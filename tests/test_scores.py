"""Scores and corpus-wide statistics on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from penstock.functions.text import sentences
from penstock.operators import graph as G
from penstock.operators import issues as I
from penstock.operators import metrics as M
from penstock.operators import stylometry as ST


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_issue_rates(spark):
    texts = [
        "The pump moves water. A pump needs water. It may run.\nThe pump stops.",
        "In order to run we made a comparison of pumps. It goes without saying. This is very good and perhaps it may delve into depth.",
        "There is a pump that runs. There is one pump.",
        "",
    ]
    got = {r.doc_id: r.asDict() for r in M.issue_rates(table(spark, *texts)).collect()}
    count = lambda d, k, n: pytest.approx(100.0 * k / n)
    assert got[0]["repeats_per_100w"] == count(0, 2, 14) and got[0]["hedges_per_100w"] == 0
    n = len(texts[1].replace(".", "").split())
    for k, v in {"wordy": 1, "weak_verbs": 1, "cliche": 1, "fillers": 1, "hedges": 2, "stock": 1}.items():
        assert got[1][f"{k}_per_100w"] == count(1, v, n), k
    assert got[2]["weak_verbs_per_100w"] == count(2, 1, 10)
    assert all(v == 0 for k, v in got[3].items() if k != "doc_id")


def test_rates_agree_with_the_issue_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = sentences(docs)
    words = s.groupBy("doc_id").agg(F.sum("n_words").alias("n"))
    rep = I.near_repeats(s).where(~F.col("word").isin(*I.QUIET)).groupBy("doc_id").agg(F.count("*").alias("k"))
    wordy = I.lexicon_hits(s, {"wordy_phrase": I.LEXICONS["wordy_phrase"]}).groupBy("doc_id").agg(F.count("*").alias("w"))
    want = {r.doc_id: (100.0 * r.k / r.n, 100.0 * r.w / r.n) for r in words.join(rep, "doc_id", "left").join(wordy, "doc_id", "left").fillna(0).collect()}
    got = {r.doc_id: (r.repeats_per_100w, r.wordy_per_100w) for r in M.issue_rates(docs).collect()}
    assert any(v[0] for v in want.values())
    for d, v in got.items():
        assert v == pytest.approx(want.get(d, (0.0, 0.0))), d


def test_every_metric_moves_its_sub_score(spark):
    plain = "The pump moves water. Two valves open slowly. Cold rain fell on every roof."
    got = {r.doc_id: r for r in M.score_documents(table(spark, plain, plain + " It goes without saying.", plain + " We ran in order to win.", plain + " Perhaps it was really very late.")).collect()}
    assert got[1].vocabulary < got[0].vocabulary and got[2].clarity < got[0].clarity and got[3].voice < got[0].voice


def test_style_chunks_run_across_documents(spark):
    # 7 words each: no document fills a chunk of ten, the corpus fills two and leaves one word.
    docs = spark.createDataFrame([(3, "the x x x x x the"), (1, "the the x x x x x"), (2, "the x x x x x x"), (4, None)], "doc_id long, text string")
    got = {r.word: (r.mean, r.sd) for r in ST.corpus_statistics(docs, 10, 3).collect()}
    assert set(got) == set(ST.FUNCTION_WORDS) and got["of"] == (0.0, 0.5)
    assert got["the"] == (pytest.approx(200.0), pytest.approx(100.0))


def test_single_meetings_count(spark):
    s = sentences(table(spark, "Take it with that. Now with this.", "Go with that."))
    concepts = spark.createDataFrame([("with",), ("that",), ("this",)], "c string")
    assert {tuple(r) for r in G.cooccurrence(s, concepts).collect()} == {(0, "that", "with", 1), (0, "this", "with", 1), (1, "that", "with", 1)}


def test_meetings_hold_what_the_filtered_query_drops(spark, sf):
    from penstock.plans import queries_rules as Q

    every = {tuple(r) for r in Q.word_meetings(spark, sf).collect()}
    assert {tuple(r) for r in Q.word_cooccurrence(spark, sf).collect()} == {r for r in every if r[3] >= 2} < every


def test_long_documents_rank_as_short_ones(spark):
    s = sentences(table(spark, "The pump moves water. The pump moves water fast. Water moves the pump. Unrelated words only.", "One thing. Another thing. No link here."))
    want = {(r.doc_id, r.sent_idx): r.rank for r in G.central_sentences(s).collect()}
    got = {(r.doc_id, r.sent_idx): r.rank for r in G.central_sentences_any_length(s, most=3).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_repeated_and_null_ids(spark):
    """Scores are a row per row, and spans of two texts with one id stay apart."""
    from penstock.functions.text import find_spans
    from penstock.operators.metrics import score_documents
    from penstock.operators.spans import merge_by_priority

    text = "The pump runs well. It was tested by the team. The valve may leak."
    docs = spark.createDataFrame([(1, text), (1, "Another text. It is short."), (None, text), (2, None), (1, text)], "doc_id long, text string")
    got = score_documents(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "1", "2", "None"]
    assert len({r.overall for r in got if r.doc_id is None} | {r.overall for r in got if r.doc_id == 1}) == 2
    two = spark.createDataFrame([(1, 'ab "quoted" c'), (1, "0123456789012")], "doc_id long, text string")
    found = find_spans(two, {"number": "[0-9]+", "quote": '"[^"]+"'}, keep=("_row",))
    assert sorted((r.start, r.end, r.kind) for r in merge_by_priority(found, ["quote", "number"], ("_row", "doc_id")).collect()) == [(0, 13, "number"), (3, 11, "quote")]
