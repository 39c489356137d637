"""Schedules of long logs."""

from penstock.operators.reviews import schedule


def test_a_long_log_is_not_one_array(spark):
    log = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id % 50) as card_id", "cast(id as double) as at_min", "cast(if(id % 1000 = 999, 1, id % 3 + 2) as int) as grade")
    cards = schedule(log)
    assert "collect_list" not in cards._jdf.queryExecution().toString()
    got = {r.card_id: r for r in cards.collect()}
    assert len(got) == 50
    lapses = {r.card_id: r["n"] for r in log.where("grade = 1").groupBy("card_id").count().withColumnRenamed("count", "n").collect()}
    assert all(r.lapses == lapses.get(c, 0) for c, r in got.items())
