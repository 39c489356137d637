"""Edits round-trip, greedy spans and nearest occurrences against plain Python."""

import random

from pyspark.sql import functions as F

from penstock.operators.editing import diff_hunks, greedy_spans, nearest_occurrence


def test_hunks_give_the_new_text(spark):
    r = random.Random(4)
    words = "the a pump valve, moves. stops (slowly) don't 12".split()
    make = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 12)))
    rows = [(k, make(), make()) for k in range(200)] + [(900, None, "x"), (901, "x", None), (902, "same", "same")]
    got = spark.createDataFrame(rows, "id long, a string, b string").select("*", diff_hunks("a", "b").alias("h")).collect()
    for x in got:
        out, at = "", 0
        for h in x.h:
            assert h.start >= at
            out += (x.a or "")[at : h.start] + h.replacement
            at = h.end
        assert out + (x.a or "")[at:] == (x.b or "")
        assert not all(p.end == q.start for p, q in zip(x.h, x.h[1:])) or len(x.h) < 2


def test_greedy_spans(spark):
    r = random.Random(5)
    rows = [(d, s, s + r.randint(0, 6)) for d in range(8) for s in (r.randint(0, 40) for _ in range(14))]
    got = {(x.doc_id, x.start, x.end) for x in greedy_spans(spark.createDataFrame(rows, "doc_id long, start long, end long")).collect()}
    expected = set()
    for d in range(8):
        at = 0
        for s, e in sorted(((s, e) for k, s, e in rows if k == d and s < e), key=lambda x: (x[0], -x[1])):
            if s >= at:
                expected.add((d, s, e))
                at = e
    assert got == expected


def test_nearest_occurrence(spark):
    rows = [("abc abc abc", "abc", 5, 4), ("abc abc", "abc", 2, 0), ("abc", "x", 0, None), ("abc", "", 0, None), ("aXa", "a", 1, 0), ("a" + "b" * 500, "a", 450, None), ("ab", "abc", 0, None)]
    df = spark.createDataFrame(rows, "t string, p string, at int, want long")
    assert all(x.got == x.want for x in df.select("want", nearest_occurrence(F.col("t"), F.col("p"), F.col("at")).alias("got")).collect())
