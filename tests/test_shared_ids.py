"""Rows that share an id, or have none: windows, groups and joins tell texts apart by row."""

from collections import Counter

from pyspark.sql import functions as F

from penstock.functions.text import sentences
from penstock.operators import flow, issues, stylometry

TEXT = "The pumping station was closed. The station opened late. The pumping went on. A valve broke."
OPENERS = "Water runs. Water falls. Water boils. Steam rises."


def rows(spark, *pairs):
    return sentences(spark.createDataFrame(list(pairs), "doc_id long, text string").repartition(3))


def times(result, n):
    return Counter({r: n * k for r, k in result.items()})


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_windows_stay_in_their_row(spark):
    for operator in (issues.near_repeats, issues.repeated_openers, flow.opener_triggers, flow.short_pairs, flow.rhythm_series, flow.crowded_transitions):
        for text in (TEXT, OPENERS, "However, it rained. However, it rained again. It rained."):
            one = found(operator(rows(spark, (1, text))))
            assert found(operator(rows(spark, (1, text), (1, text), (1, text)))) == times(one, 3), operator.__name__
            none = found(operator(rows(spark, (None, text), (None, text))))
            assert none == Counter({(None, *r[1:]): 2 * k for r, k in one.items()}), operator.__name__
    assert found(issues.near_repeats(rows(spark, (1, TEXT)))) == Counter({(1, 1, "station"): 1, (1, 2, "pumping"): 1})
    assert not found(issues.repeated_openers(rows(spark, (1, "Water runs."), (1, "Water falls."), (1, "Water boils."))))


def test_rates_of_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "the cat of it"), (2, "the cat of it")], "doc_id long, text string")
    got = {(r.doc_id, r.word): r.rate for r in stylometry.function_word_rates(docs).collect()}
    assert got[None, "the"] == got[2, "the"] == 250.0 and got[None, "of"] == 250.0


def test_first_mentions(spark):
    """A number is late if the one before it has not been introduced: against the plain definition."""
    import random

    r = random.Random(4)
    for _ in range(20):
        order = [r.randrange(1, 8) for _ in range(r.randrange(1, 12))]
        firsts = list(dict.fromkeys(order))
        want = {(n, k + 1) for k, n in enumerate(firsts) if n > k + 1 and n - 1 not in firsts[:k]}
        mentions = spark.createDataFrame([(1, "figure", n, 10 * k) for k, n in enumerate(order)], "doc_id long, kind string, number long, start long")
        assert {(x.number, x.place) for x in flow.first_mention_order(mentions).collect()} == want
    assert F is not None
