"""Offsets, folds and scores against plain Python."""

import math
import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from penstock.functions import scalars as C
from penstock.functions import text as T
from penstock.operators import metrics as M
from penstock.operators import spans as S


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")


def test_spans_slice_back(spark, docs):
    patterns = {"word": r"[A-Za-z]+", "caps": r"[A-Z]{2,6}", "number": r"[0-9]+(?:[.,][0-9]+)*"}
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {(r.doc_id, r.kind, r.start, r.end, r.surface) for r in T.find_spans(docs, patterns).collect()}
    assert got == {(d, k, m.start(), m.end(), m.group()) for d, t in text.items() for k, p in patterns.items() for m in re.finditer(p, t)}


def test_paragraph_offsets(spark):
    rows = [(1, " a b \n\n  c\n d \n \n\ne "), (2, "x\n  y \n"), (3, ""), (4, None), (5, "one"), (6, "\n\n\n")]
    got = T.paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    assert all(text[r.doc_id][r.start : r.end] == r.para_text for r in got)
    assert [r.para_text for r in got if r.doc_id == 1] == ["a b", "c\n d", "e"] and [r.para_text for r in got if r.doc_id == 2] == ["x", "y"]
    assert {r.doc_id for r in got} == {1, 2, 5}


def test_sentences_of_null_and_blank(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n 12."), (4, 'A b. "C d?" E (f). Go')], "doc_id long, text string")
    assert [r.sentence for r in T.sentences(df).collect()] == ["A b.", '"C d?" E (f).', "Go"]


def similar(a, b):
    return abs(a - b) <= max(2.0, 0.15 * max(a, b))


def brute_runs(sents):
    runs, cur = 0, []
    for p, n in sents:
        if cur and p == cur[-1][0] and all(similar(n, m) for _, m in cur):
            cur.append((p, n))
        else:
            runs += len(cur) >= 3
            cur = [(p, n)]
    return runs + (len(cur) >= 3)


def test_rhythm(spark, docs):
    sents = {}
    for r in T.sentences(docs).collect():
        sents.setdefault(r.doc_id, []).append((r.sent_idx, r.para_idx, r.n_words, r.words[0].lower()))
    for r in M.rhythm(docs).collect():
        s = sorted(sents.get(r.doc_id, []))
        n = [x[2] for x in s]
        assert r.n_sents == len(s) and r.monotone_runs == brute_runs([(x[1], x[2]) for x in s])
        if len(n) >= 2:
            mean = sum(n) / len(n)
            assert r.sentence_length_sd == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in n) / len(n)), abs=1e-9)
        if len(n) >= 3:
            counts = [len(list(g)) for _, g in groupby(sorted(x[3] for x in s))]
            assert r.opener_entropy == pytest.approx(-sum(c / len(n) * math.log(c / len(n)) for c in counts) / math.log(len(n)), abs=1e-9)


def factors(words):
    done, start = 0.0, 0
    for k in range(len(words)):
        part = words[start : k + 1]
        if len(set(part)) / len(part) <= 0.72:
            done, start = done + 1, k + 1
    part = words[start:]
    if part and len(set(part)) < len(part):
        done += (1 - len(set(part)) / len(part)) / 0.28
    return len(words) / done if done else len(words)


def test_mtld(docs):
    got = {r.doc_id: r.mtld for r in M.vocabulary(docs).collect()}
    for r in docs.collect():
        w = [x.lower() for x in re.findall(T.WORD, r.text)]
        assert got[r.doc_id] == pytest.approx((factors(w) + factors(w[::-1])) / 2 if len(w) >= 10 else 0.0)


def test_band_score(spark):
    points = [(0, 100), (2, 85), (4, 65)]
    rows = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (3.0,), (4.0,), (9.0,)], "x double").select(C.band_score(F.col("x"), points).alias("y")).collect()
    assert [r.y for r in rows] == pytest.approx([100, 100, 92.5, 75, 65, 65])


def test_overall_drops_missing(spark):
    df = spark.createDataFrame([(80.0, None, 60.0), (None, None, None)], "clarity double, rhythm double, voice double")
    got = [r.s for r in df.select(M.overall_score(["clarity", "rhythm", "voice"]).alias("s")).collect()]
    assert got[0] == pytest.approx(round((80 * 0.25 + 60 * 0.2) / 0.45, 1)) and got[1] is None


def test_span_algebra_on_random_spans(spark):
    r = random.Random(2)
    rows = [(d, s, s + r.randint(0, 9), r.choice("abc")) for d in range(6) for s in (r.randint(0, 60) for _ in range(15))]
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, kind string")
    merged = {(x.doc_id, x.start, x.end) for x in S.merge_spans(df).collect()}
    for d in range(6):
        out = []
        for s, e in sorted((s, e) for k, s, e, _ in rows if k == d):
            if out and s <= out[-1][1]:
                out[-1] = out[-1][0], max(out[-1][1], e)
            else:
                out.append((s, e))
        assert {(d, *x) for x in out} == {x for x in merged if x[0] == d}
    named = S.merge_by_priority(df.where("start < end"), ["b", "a", "c"]).collect()
    for x in named:
        kinds = [k for d, s, e, k in rows if d == x.doc_id and x.start <= s and e <= x.end and s < e]
        assert x.kind == min(kinds, key="bac".index)
    ends = sorted((x.doc_id, x.start, x.end) for x in named)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(ends, ends[1:]))
