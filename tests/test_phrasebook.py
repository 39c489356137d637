"""Phrases in all their forms against one long alternation, and what their wordings look like."""

import random
import re

import pytest

from penstock.operators import phrasebook as B

BOOK = B.build_phrases()
TRIE = B.build_trie(BOOK)
ROWS = {p.surface: p for p in BOOK}
PATTERNS = [(s, re.compile(r"(?<![\w-])" + r"\s+".join(re.escape(w).replace("'", "['’]") for w in s.split()) + r"(?![\w-])", re.I)) for s in ROWS]


def plain_matches(text):
    """Every start from the left, the longest phrase that ends at a boundary; then on from its end."""
    out, at = [], 0
    found = sorted((m.start(), -m.end(), s) for s, rx in PATTERNS for m in rx.finditer(text))
    for start, end, surface in found:
        if start >= at:
            out.append((start, -end, surface))
            at = -end
    return out


def made_texts(n=150):
    rng = random.Random(11)
    words = ["make", "made", "Make", "MAKING", "a", "an", "the", "comparison", "analysis", "of", "study", "-", "of-", "’", "'", ".", "\n", "  ", "in", "careful", "way", "carry", "out", "carried", "very", "order", "to", "é", "x1", "_", "large", "number", "TEST", "gave", "answer", "lot"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    surfaces = [p.surface for p in BOOK]
    return texts + [rng.choice([" ", "", "-", "’"]).join(rng.choice(surfaces) for _ in range(5)) for _ in range(n // 3)]


def test_matches_equal_every_pattern_by_itself():
    texts = made_texts(60)
    assert sum(len(plain_matches(t)) for t in texts) > 60
    for t in texts:
        assert [(a, b, BOOK[i].surface) for a, b, i in B.matches(t, TRIE)] == plain_matches(t), t


def test_there_are_hundreds_of_phrases_in_all_forms():
    assert len({p.key for p in BOOK}) >= 300
    assert {f.form for f in BOOK if f.key == "make a comparison of"} == {"base", "s", "past", "ing"}  # the participle is the past
    assert ROWS["taken a study of"].wording == "studied" and ROWS["carries out the analysis of"].wording == "analyses"
    assert ROWS["in an efficient manner"].wording == "efficiently" and ROWS["in a simple way"].wording == "simply" and ROWS["of a similar nature"].wording == "similar"


@pytest.mark.parametrize(
    "verb,forms",
    [
        ("study", ["study", "studies", "studied", "studied", "studying"]),
        ("choose", ["choose", "chooses", "chose", "chosen", "choosing"]),
        ("undertake", ["undertake", "undertakes", "undertook", "undertaken", "undertaking"]),
        ("carry out", ["carry out", "carries out", "carried out", "carried out", "carrying out"]),
        ("do", ["do", "does", "did", "done", "doing"]),
        ("assess", ["assess", "assesses", "assessed", "assessed", "assessing"]),
    ],
)
def test_verb_forms(verb, forms):
    assert list(B.verb_forms(verb).values()) == forms


@pytest.mark.parametrize(
    "surface,wording,expected",
    [("Made a test of", "tested", "Tested"), ("MADE A TEST OF", "tested", "TESTED"), ("made a test of", "tested", "tested"), ("Very", "", ""), ("x", None, None)],
)
def test_render(surface, wording, expected):
    assert B.render(wording, surface) == expected


def test_table(spark):
    texts = ["She made a comparison  of x.", "Don’t make a study-of it", None, "", "very " * 20_000]
    docs = spark.createDataFrame([(7 if i < 2 else None, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, wording string")
    got = B.find_phrases(docs).collect()
    assert [(r.doc_id, r.start, r.end, r.phrase, r.form, r.surface, r.wording) for r in got if r.doc_id == 7] == [(7, 4, 25, "make a comparison of", "past", "made a comparison  of", "compared")]
    rest = [r for r in got if r.doc_id is None]
    assert len(rest) == 20_000 and len({r._row for r in rest}) == 1 and sorted(r.start for r in rest) == list(range(0, 100_000, 5))
    assert B.find_phrases(docs.limit(0)).count() == 0


def test_own_phrases_with_apostrophes(spark):
    own = [B.Phrase("don't worry", "don't worry", "base", None), B.Phrase("worry", "worry", "base", "care")]
    docs = spark.createDataFrame([(1, "Don’t  worry, do not WORRY, worry-free")], "doc_id long, text string")
    assert [(r.surface, r.wording) for r in B.find_phrases(docs, own).orderBy("start").collect()] == [("Don’t  worry", None), ("WORRY", "CARE")]


def test_words_that_start_no_phrase_are_passed_over(monkeypatch):
    from types import SimpleNamespace

    from penstock.operators import phrasebook as P

    trie = P.build_trie(P.build_phrases())
    walked, piece = [], P.PIECE
    counted = lambda f: lambda *a: walked.append(a) or f(*a)
    monkeypatch.setattr(P, "PIECE", SimpleNamespace(match=counted(piece.match), finditer=lambda *a: (counted(lambda m: m)(m) for m in piece.finditer(*a))))
    text = "zebra, quilt " * 200 + "make a comparison of it"
    assert [(text[a:b]) for a, b, _ in P.matches(text, trie)] == ["make a comparison of"]
    assert len(walked) < 20
