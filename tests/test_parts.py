"""How much of a table one task gets: so many bytes of its files at most, however large the table and whatever the session's number of partitions."""

from penstock.operators import keyphrases as K
from penstock.sources import tables as S


def test_a_table_of_few_or_large_files_is_dealt_by_its_bytes(spark, sf, tmp_path, monkeypatch):
    path = f"{sf}/documents.parquet"
    table = spark.read.parquet(path)
    size = S.input_bytes(table)
    assert size == sum(len(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert S.input_bytes(spark.createDataFrame([(1,)], "a long")) == 0
    assert S.read_table(spark, path).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    table.repartition(8).write.parquet(f"{tmp_path}/eight files")
    monkeypatch.setattr(S, "TASK_BYTES", size // 20)
    assert S.read_table(spark, path).rdd.getNumPartitions() >= 20
    assert S.read_table(spark, f"{tmp_path}/eight files", even=True).rdd.getNumPartitions() >= 16
    dealt = S.read_table(spark, f"{tmp_path}/eight files", even=True)
    assert sorted(map(tuple, dealt.select("doc_id", "text").collect())) == sorted(map(tuple, table.select("doc_id", "text").collect()))
    few = spark.read.parquet(f"{tmp_path}/eight files")
    assert abs(S.input_bytes(few, 4) / S.input_bytes(few) - 1) < 0.5


def test_tokens_of_so_many_bytes_are_one_task(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(K, "PART_BYTES", S.input_bytes(docs) // 30)
    assert K.placed_tokens(docs).rdd.getNumPartitions() >= 30


def test_joins_of_spans_are_dealt_by_bytes_in_every_session(spark, sf, monkeypatch):
    from penstock.operators import spans as P

    rows = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey doc_id", "l_partkey % 90 start", "l_partkey % 90 + 5 end", "'a' kind")
    windows = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey doc_id", "1 window_id", "30 start", "60 end")
    want = [sorted(map(tuple, x.collect())) for x in (P.with_overlap(rows, windows), P.without_overlap(rows, windows), P.fully_covered(rows, windows), P.clipped(rows, windows))]
    monkeypatch.setattr(P, "PART_BYTES", S.input_bytes(rows) // 30)
    parts = [P.with_overlap(rows, windows), P.without_overlap(rows, windows), P.fully_covered(rows, windows), P.clipped(rows, windows)]
    assert [sorted(map(tuple, x.collect())) for x in parts] == want and len(want[0]) + len(want[1]) == rows.count()
    assert all(x.rdd.getNumPartitions() >= 30 for x in parts)
