"""Keyphrases: every phrase of a text stands in line, and a text of any script, size and spelling gives what plain Python gives."""

import random
from collections import defaultdict

from penstock.operators import keyphrases as K
from penstock.plans import queries_terms as Q

from .test_terms import plain_keyphrases

EVERY = 10**9


def of(rows, key):
    got = defaultdict(list)
    for r in rows:
        got[r[key]].append((r.place, r.phrase, r.n, round(r.score, 6), r.start, r.end))
    return {k: sorted(v) for k, v in got.items()}


def wanted(text):
    return [(i, p, n, round(s, 6), a, b) for i, p, n, s, a, b in plain_keyphrases(text, pool=EVERY)]


def alike_first(seed=3):
    """Many phrases that are near copies of a few, so that the ten that stay are far down the line."""
    rng = random.Random(seed)
    near = [f"calibrated{a}{b}" for a in "abcdef" for b in "abcdef"]
    far = "Glacier meadow. Harbour lantern. Timber violin. Pepper saddle. Quarry ribbon. Copper falcon. Marble thistle. Walnut compass. Orchid anvil. Velvet beacon."
    return " ".join(f"{w.title()}." for w in rng.sample(near, len(near))) + " " + " ".join(f"{w}." for w in near for _ in range(3)) + "\n" + far


def test_a_text_whose_best_phrases_are_alike_still_gets_ten(spark):
    text = alike_first()
    rows = K.keyphrases(spark.createDataFrame([(1, text)], "doc_id long, text string"), pool=None).collect()
    assert of(rows, "doc_id") == {1: wanted(text)} and len(rows) == 10 > len(plain_keyphrases(text))


def test_the_query_and_the_terms_take_every_phrase(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.keyphrases(spark, sf).collect()
    want = {d: w for d, t in texts.items() if (w := wanted(t))}
    assert {d: [(i, p, n, a, b) for i, p, n, _, a, b in v] for d, v in of(rows, "doc_id").items()} == {d: [(i, p, n, a, b) for i, p, n, _, a, b in v] for d, v in want.items()}
    terms = {(r.doc_id, r.surface) for r in Q.protected_terms(spark, sf).collect()}
    assert terms == {(d, p) for d, v in want.items() for _, p, n, *_ in v if n >= 2 or " " in p}


def odd_texts(n=300, seed=7):
    rng = random.Random(seed)
    letters = ["a", "b", "B", "é", "É", "ß", "ñ", "'", "’", "-", " ", " ", " ", "\n", "\t", "\r", "1", "_", ".", "!", ",", "“", "(", "Σ", "я", "中", "𝄞"]
    words = ["alpha", "Alpha", "ALPHA", "the", "Gamma-ray", "don't", "été", "ÉTÉ", "x", "Straße", "alphas", "alphabet", "1990", "...", "“Quote", "(Note", "über"]
    for k in range(n):
        pool, ends, size = (letters, [""], 60) if k % 2 else (words, [" ", " ", "\n", ". ", "! ", ", ", "-", ""], 40)
        yield "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randrange(size)))


def test_odd_texts_in_blocks_of_any_size_equal_brute_force(spark, monkeypatch):
    texts = [*odd_texts(), None, "", alike_first()]
    for block in (1, 500, 1 << 20):  # a text of its own each; some; all
        monkeypatch.setattr(K, "BLOCK", block)
        got = defaultdict(list)
        first = 0
        for start, held in K._blocks(K.pa.array(texts)):
            assert start == first
            first += len(held)
            for d, *r in K.block_phrases(held, 10, None, 0.8):
                got[start + d].append((*r[:3], round(r[3], 8), *r[4:]))
        assert first == len(texts)
        assert dict(got) == {i: w for i, t in enumerate(texts) if (w := plain_keyphrases(t, pool=EVERY))}


def test_a_text_takes_one_exchange_and_no_window(spark, sf):
    plan = Q.keyphrases(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Join" not in plan


def test_tokens_are_words_and_other_signs(spark):
    rows = K.placed_tokens(spark.createDataFrame([(7, "It's 1990.  A-b 'c'\nd"), (7, None), (8, " x")], "doc_id long, text string"))
    got = sorted((r.doc_id, r.pos, r.token, r.start, r.end, r.sent) for r in rows.collect())
    assert got == [(7, 0, "It's", 0, 4, 0), (7, 1, "1990.", 5, 10, 0), (7, 2, "A-b", 12, 15, 1), (7, 3, "'", 16, 17, 1), (7, 4, "c'", 17, 19, 1), (7, 5, "d", 20, 21, 2), (8, 0, "x", 1, 2, 0)]


def test_edit_distances_within_a_bound():
    from .test_terms import distance

    rng = random.Random(1)
    for _ in range(5000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        most = rng.randrange(-1, 5)
        assert K.within(a, b, most) == (distance(a, b) <= most)
    assert [K.most_edits(n, 0.8) for n in (1, 5, 6, 10, 11, 16)] == [max((k for k in range(n) if 1 - k / n > 0.8), default=-1) for n in (1, 5, 6, 10, 11, 16)]


def test_terms_take_one_exchange_and_no_window(spark, sf):
    plan = Q.protected_terms(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and not any(x in plan for x in ("Window", "Sort", "Join", "Generate"))
