"""Keyphrases and card ids against plain versions of the same rules."""

import math
import re
import statistics
from collections import Counter, defaultdict

import pytest

from penstock.functions.scalars import fnv1a36
from penstock.operators import keyphrases as K

TEXTS = [
    "The soil sensor measures moisture. The Soil Sensor of Bristol reports to NASA, and soil moisture sensors drift.\nA soil sensor drifts when NASA waits.",
    "Kalman filter, Kalman filter; kalman filters! Noise covariance matrix tuning improves the Kalman filter. We tune the noise covariance matrix.",
    "Élan vital et élan mental. L’été dernier, Été chaud; ÉTÉ chaud.",
    "word word word word",
    "of the and in",
    "x",
    "",
    None,
    "12 5 !! ...",
    "tie alpha. tie gamma. tie delta.",
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_keyphrases(text, top=10, pool=30, alike=0.8):
    toks, sent = [], -1
    for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|['’-])*|[^\s\w]+|[\d_]+", text or ""):
        gap = text[toks[-1][2] : m.start()] if toks else ""
        before = toks[-1][0] if toks else ""
        if not toks or "\n" in gap or (before[-1] in ".!?" and gap and re.match('[A-Z"“(]', m.group())):
            sent, fresh = sent + 1, True
        else:
            fresh = False
        toks.append((m.group(), m.start(), m.end(), sent, fresh))
    words = [(i, t.lower(), t, s, e, k, f) for i, (t, s, e, k, f) in enumerate(toks) if t[0].isalpha()]
    if not words:
        return []
    at = {w[0]: w for w in words}
    by = defaultdict(list)
    for w in words:
        by[w[1]].append(w)
    stop = {w: len(w) < 3 or w in K.STOP for w in by}
    tfs = [len(v) for w, v in by.items() if not stop[w]]
    usual = statistics.fmean(tfs) + statistics.pstdev(tfs) if tfs else 1.0
    most, n_sent = max(len(v) for v in by.values()), max(w[5] for w in words) + 1
    weight = {}
    for w, occ in by.items():
        tf = len(occ)
        context = 0.0
        for step in (-1, 1):
            near = [at[o[0] + step][1] for o in occ if o[0] + step in at and at[o[0] + step][5] == o[5]]
            context += len(set(near)) / len(near) if near else 0.0
        caps = sum(o[2][0] != o[1][0] and not o[6] for o in occ)
        loud = sum(len(x) > 1 and x == x.upper() for x in ("".join(c for c in o[2] if c.isalpha()) for o in occ))
        sents = {o[5] for o in occ}
        rel = 1 + context * tf / most
        weight[w] = rel * math.log(math.log(3 + statistics.median(sents))) / (max(caps, loud) / (1 + math.log(tf)) + tf / usual / rel + len(sents) / n_sent / rel)
    n, first, parts = Counter(), {}, {}
    for w in words:
        chain = []
        for k in range(3):
            x = at.get(w[0] + k)
            if x is None or x[5] != w[5] or stop[x[1]]:
                break
            chain.append(x)
            phrase = " ".join(c[1] for c in chain)
            n[phrase] += 1
            first.setdefault(phrase, (w[3], x[4]))
            parts[phrase] = [weight[c[1]] for c in chain]
    score = {p: math.prod(v) / (n[p] * (1 + sum(v))) for p, v in parts.items()}
    kept = []
    for p in sorted(score, key=lambda p: (round(score[p], 10), p))[:pool]:
        if len(kept) < top and not any(p in q or q in p or 1 - distance(p, q) / max(len(p), len(q)) > alike for q in kept):
            kept.append(p)
    return [(i, p, n[p], round(score[p], 8), *first[p]) for i, p in enumerate(kept)]


@pytest.fixture(scope="module")
def found(spark, sf):
    own = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return K.keyphrases(own).collect()


def test_keyphrases_equal_brute_force(found):
    got = defaultdict(list)
    for r in found:
        got[r._row].append((r.place, r.phrase, r.n, round(r.score, 8), r.start, r.end))
    expected = [e for t in TEXTS if (e := plain_keyphrases(t))]
    assert sorted(sorted(v) for v in got.values()) == sorted(expected)


def test_places_hold_the_phrases(found):
    texts = [t for t in TEXTS if t]
    for r in found:
        assert any(re.sub(r"\s+", " ", t[r.start : r.end]).lower() == r.phrase for t in texts)


def test_keyphrases_of_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = defaultdict(list)
    for r in K.keyphrases(docs).collect():
        got[r.doc_id].append((r.place, r.phrase, r.n, round(r.score, 8), r.start, r.end))
    rows = docs.collect()
    assert got
    assert {k: sorted(v) for k, v in got.items()} == {r.doc_id: e for r in rows if (e := plain_keyphrases(r.text))}


def test_terms_are_long_or_frequent(spark):
    own = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    surfaces = {r.surface for r in K.terms(own).collect()}
    assert any("kalman" in s for s in surfaces) and all(" " in s or TEXTS[1].lower().count(s) >= 2 for s in surfaces)


def test_no_rows_no_phrases(spark):
    assert K.keyphrases(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_fnv(text):
    raw = text.encode("utf-16-be")
    h = 0x811C9DC5
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    digits = ""
    while True:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not h:
            return digits


def test_card_ids(spark):
    texts = ["", "a", "foobar", "été", "𝄞 clef", "x" * 5000, "日本", "\n"]
    rows = spark.createDataFrame([(t,) for t in texts + [None]], "t string")
    assert {r.t: r.h for r in rows.select("t", fnv1a36(rows.t).alias("h")).collect()} == {**{t: plain_fnv(t) for t in texts}, None: None}
