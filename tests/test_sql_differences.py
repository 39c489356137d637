"""Where Spark and SQL went apart on larger tables: capitals, roundings at a half, spans that tie."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from penstock.functions.scalars import capital
from penstock.operators import metrics as M
from penstock.operators import rewriting as W
from penstock.operators import spans as S

LETTERS = ["a", "é", "ß", "ŉ", "ﬁ", "ᾳ", "ΐ", "я", "Q", "1", "“", "ǆ", "ﬅ", "ῷ", ""]


def test_capitals_are_those_of_sql_and_one_letter(spark):
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(LETTERS)], "i int, x string").orderBy("i").select(capital(F.col("x")).alias("c")).collect()]
    assert got == [duckdb.execute("SELECT upper(?)", [x]).fetchall()[0][0] for x in LETTERS]


def test_a_rewrite_that_only_raises_the_first_letter_keeps_the_length(spark):
    rows = W.candidates(spark.createDataFrame([(1, 0, "ßa word.")], "doc_id long, sent_idx long, sentence string")).collect()
    assert {r.text for r in rows} == {"ẞa word."}


def test_halves_are_rounded_as_in_sql(spark):
    values = [(a / n - 11.0) / 5.0 for n in (32, 96, 160) for a in range(1, 30 * n)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r.i: r.y for r in rows.select("i", M.rounded(F.col("x"), 4).alias("y")).collect()}
    con = duckdb.connect()
    want = [con.execute(f"SELECT list_transform({values[k:k + 2000]!r}::DOUBLE[], lambda x: round(x, 4))").fetchall()[0][0] for k in range(0, len(values), 2000)]
    assert [got[i] for i in range(len(values))] == [x for w in want for x in w]


def test_a_spread_of_large_equal_values_is_nothing(spark):
    row = spark.createDataFrame([([100_000_000.1] * 3, [1.0, 17.0], [])], "a array<double>, b array<double>, c array<double>").select(M.spread("a"), M.spread("b"), M.spread("c")).first()
    assert tuple(row) == (0.0, 8.0, None)


def islands(rows, touching):
    out = []
    for s, e in sorted(rows):
        if out and (s <= out[-1][1] if touching else s < out[-1][1]):
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("touching", [True, False])
def test_spans_that_tie_are_one_island(spark, touching):
    rng = random.Random(5)
    rows = [(d, s, s + n, rng.choice("ab")) for d in range(300) for s, n in [(rng.randrange(12), rng.randrange(1, 4)) for _ in range(4)] for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(rows, "doc_id long, start long, end long, kind string").repartition(7)
    got = S.merge_spans(df) if touching else S.merge_by_priority(df, ["a", "b"])
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {d: sorted(x) for d, x in found.items()} == {d: islands([(s, e) for k, s, e, _ in rows if k == d], touching) for d in range(300)}
