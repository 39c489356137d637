"""Gists against a plain version: ranks by repeated sums over dictionaries, phrases by one alternation."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from penstock.functions.text import sentences
from penstock.operators import gist as G
from penstock.session import checkpointed

TEXTS = [
    "The pump moves water to the tank. The tank holds water for the town. Cats sleep all day long. The pump moves water from the river to the tank. Short one.",
    "However, it is very hot in here (see Fig. 2), in order to test it. No.",
    "One two three. Four five six seven. Eight nine ten eleven.",
    "Tiny. Few words here.",
    "Alpha beta gamma delta. Alpha beta gamma delta. Alpha beta gamma delta.",
    " ".join(f"word{chr(97 + i % 26)}" for i in range(40)) + ".",
    "(only brackets) very. (nothing else here) very.",
    "",
    None,
    "12 34.",
]


def plain_central(rows):
    """rows: (sent_idx, words, n_words) of a text."""
    own = [r for r in rows if r[2] >= 4] or rows
    if len(own) <= 2:
        return max(own, key=lambda r: (r[2], -r[0]))[0]
    bags = [Counter(w.lower() for w in r[1]) for r in own]

    def cosine(a, b):
        return sum(a[w] * b[w] for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    n = len(own)
    w = [[0 if i == j else cosine(bags[i], bags[j]) for j in range(n)] for i in range(n)]
    out = [sum(x) for x in w]
    rank = [1 / n] * n
    for _ in range(300):
        loose = sum(r for r, o in zip(rank, out) if o == 0)
        rank = [0.15 / n + 0.85 * (sum(rank[i] * w[i][j] / out[i] for i in range(n) if out[i]) + loose / n) for j in range(n)]
    rank[0] *= 1.15
    top = max(rank)
    return own[max(range(n), key=lambda i: (round(rank[i] / top, 6), -i))][0]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(None if i == 4 else i // 2, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


@pytest.mark.parametrize("dense", [500, 3])
def test_central_sentences_equal_a_plain_version(spark, sf, docs, dense):
    some = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2500").select("doc_id", "text") if dense == 500 else docs
    own = checkpointed(sentences(some).select("_row", "doc_id", "sent_idx", "sentence", "words", "n_words"))
    texts = {}
    for r in own.orderBy("_row", "sent_idx").collect():
        texts.setdefault(r._row, []).append((r.sent_idx, r.words, r.n_words))
    got = {r._row: r.sent_idx for r in G.central_rows(own, dense).collect()}
    assert len(got) >= 6 and got == {k: plain_central(v) for k, v in texts.items()}


def test_gists(docs):
    got = sorted((r.sentence, r.gist) for r in G.gists(docs).collect())
    said = {s[:12]: g for s, g in got}
    assert len(got) == 7  # none of the null, the empty text and the one without words
    assert said["However, it "] == "It is hot in here, to test it."
    assert said["Alpha beta g"] == "Alpha beta gamma delta."
    long_ = next(g for s, g in got if s.startswith("worda"))
    assert len(long_.split()) == 22 and long_.endswith("…") and long_.startswith("Worda")
    assert next(g for s, g in got if s.startswith("(")) is None
    assert all(g is None or (len(g.split()) <= 22 and g[-1] in ".!?…" and g[0] == g[0].upper()) for _, g in got)


@pytest.mark.parametrize("text,expected", [("  a  b , ", "A b."), ("x!", "X!"), (" ,;: ", None), ("", None), ("a " * 30, "A" + " a" * 21 + "…"), ("é a", "É a.")])
def test_shortened(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(G.shortened(F.col("t"))).first()[0] == expected


def test_phrases_go_in_their_case(spark):
    texts = ["In order to see, we made a comparison of it", "very VERY good", "It is worth noting a thing", "nothing"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(G.put_plainly("t")).collect()]
    assert [re.sub(r"\s+", " ", x).strip() for x in got] == ["To see, we compared it", "good", "a thing", "nothing"]


def test_no_rows(docs):
    assert G.gists(docs.limit(0)).count() == 0
