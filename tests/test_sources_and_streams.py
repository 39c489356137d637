"""Round trips of readers and writers; the stream's state against the batch fold."""

import pytest
from pyspark.sql import functions as F

from penstock.operators import language_model as LM
from penstock.operators.reviews import schedule
from penstock.plans import fixtures as X
from penstock.sources import tables as S
from penstock.streaming.reviews import daily_counts, stream_schedule


def test_formats(spark, tmp_path):
    rows = [(1, 'a "b", c\nd', "en", "s"), (2, None, None, None), (3, "é\\", "fr", "s")]
    df = spark.createDataFrame(rows, S.DOCUMENTS)
    for kind in ("parquet", "json", "orc", "csv"):
        writer = df.coalesce(1).write.format(kind)
        (writer.options(header=True, escape='"') if kind == "csv" else writer).save(str(tmp_path / kind))
        assert sorted(map(tuple, S.read_documents(spark, str(tmp_path / kind), kind).collect())) == sorted(rows)
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("whole\nfile")
    assert [r.text for r in S.read_documents(spark, str(tmp_path / "t"), "text").collect()] == ["whole\nfile"]


def test_limit_and_lines(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, None), (4, " = Head = \n x \n\n y")], "doc_id long, text string")
    inside, over = S.within_word_limit(df, 3)
    assert {r.doc_id for r in inside.collect()} == {1, 3} and {r.doc_id for r in over.collect()} == {2, 4}
    assert [r.line for r in S.corpus_lines(df.where("doc_id = 4")).collect()] == [" x ", " y"]


def test_ngram_store(spark, tmp_path):
    counts = LM.count_ngrams(X.LM_CORPUS.df(spark))
    S.write_ngrams(counts, str(tmp_path / "lm"))
    again = S.read_ngrams(spark, str(tmp_path / "lm"))
    a, b = (LM.score_texts(X.LM_TESTS.df(spark), c).orderBy("id").collect() for c in (counts, again))
    assert [r.slor for r in a] == pytest.approx([r.slor for r in b]) and len(a) == 3


def test_reflow(spark):
    lines = [(1, k, t) for k, t in enumerate(["The first sen-", "tence wraps", "here. And goes on.", "A new one", "", "Last"])]
    got = S.reflow(spark.createDataFrame(lines, "doc_id long, line_idx long, line string")).collect()
    assert [r.para_text for r in got] == ["The first sentence wraps here. And goes on.", "A new one", "Last"]


def test_stream_equals_batch(spark, tmp_path):
    """The log in three files, a micro-batch each: the last state of each card is that of the batch fold."""
    log = X.REVIEWS.df(spark)
    odd = [(1, 50.0, 0), (1, 60.0, 9), (2, 70.0, None), (5, 20.0, 0), (6, None, 3), (6, 30.0, 2), (7, 50.0, 1), (7, 60.0, 5)]
    log = log.unionByName(spark.createDataFrame(odd, log.schema)).selectExpr("card_id", "at_min", "grade")
    for k, part in enumerate(("at_min < 100 or at_min is null", "at_min >= 100 and at_min < 20000", "at_min >= 20000")):
        log.where(part).coalesce(1).write.parquet(str(tmp_path / "log" / f"p{k}"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "log"))
    q = stream_schedule(stream).writeStream.outputMode("update").format("memory").queryName("cards").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("cards").groupBy("card_id").agg(F.max_by(F.struct("reps", "lapses", "due"), F.col("reps") + F.col("lapses") * 100 + F.col("due") / 1e9).alias("s")).collect()
    batch = {r.card_id: r for r in schedule(log).collect()}
    assert {r.card_id for r in last} == set(batch) == {1, 2, 3, 6, 7}
    assert all((r.s.lapses, round(r.s.due, 6)) == (batch[r.card_id].lapses, round(batch[r.card_id].due, 6)) for r in last)


def test_daily_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()
