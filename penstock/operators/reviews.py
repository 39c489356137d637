"""Spaced repetition over review logs: SM-2 states, due cards, streaks; the same fold as a streaming operator."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How well an answer of each grade was known. Any other grade, and none, is no review.
QUALITY = {1: 1, 2: 3, 3: 4, 4: 5}
#: ease, interval, reps, lapses, due of a card that was never reviewed.
NEW_CARD = (2.5, 0.0, 0, 0, None)


def is_review(grade: Column) -> Column:
    return F.coalesce(grade.isin(*QUALITY), F.lit(False))


def review(card: tuple, grade: int, at: float | None) -> tuple:
    """The card after one review; batch and stream fold with this. Without a time there is no due time."""
    ease, interval, reps, lapses, _ = card
    miss = 5 - QUALITY[grade]
    ease = max(1.3, ease + (0.1 - miss * (0.08 + miss * 0.02)))
    if grade == 1:
        interval, reps, lapses, wait = 0.0, 0, lapses + 1, 10.0
    else:
        reps += 1
        # As Spark's floor, which stops at the largest long.
        interval = 1.0 if reps == 1 else 6.0 if reps == 2 else float(math.floor(min(interval * ease + 0.5, 2.0**63)))
        wait = interval * 1440.0
    return ease, interval, reps, lapses, None if at is None else at + wait


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States of the cards of rows sorted by card and time; only the card at hand is held."""
    none = object()
    now, state = none, NEW_CARD
    for batch in batches:
        rows = []
        for card, at, grade in zip(*(batch.column(k).to_pylist() for k in ("card_id", "at_min", "grade"))):
            if now is none or card != now:
                if now is not none:
                    rows.append((now, *state))
                now, state = card, NEW_CARD
            state = review(state, grade, at)
        yield _cards(rows, batch.schema.field("card_id").type)
    if now is not none:
        yield _cards([(now, *state)], batch.schema.field("card_id").type)


def _cards(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = {"card_id": kind, "ease": pa.float64(), "interval": pa.float64(), "reps": pa.int32(), "lapses": pa.int32(), "due": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types.values())], names=list(types))


def schedule(reviews: DataFrame) -> DataFrame:
    """card_id, ease, interval, reps, lapses, due after all reviews (card_id, at_min, grade), in order of time.

    A card's rows are sorted in one task and folded as they come, so memory does not depend on the length of its log.
    Rows whose grade is not 1 to 4 are no reviews and are passed over; a card without a review has no state.
    """
    rows = reviews.where(is_review(F.col("grade"))).select("card_id", F.col("at_min").cast("double").alias("at_min"), F.col("grade").cast("int").alias("grade"))
    kind = rows.schema["card_id"].dataType.simpleString()
    rows = rows.repartition("card_id").sortWithinPartitions("card_id", "at_min", "grade")
    return rows.mapInArrow(folded, f"card_id {kind}, ease double, interval double, reps int, lapses int, due double")


def due_cards(cards: DataFrame, now: float) -> DataFrame:
    return cards.where(F.col("due") <= now).withColumn("place", F.row_number().over(Window.orderBy("due", "card_id")))


def streaks(events: DataFrame, who: str = "user_id", ts: str = "ts") -> DataFrame:
    """who, first_day, last_day, days: runs of consecutive days with an event."""
    days = events.select(who, F.to_date(ts).alias("day")).distinct()
    run = F.date_sub("day", F.row_number().over(Window.partitionBy(who).orderBy("day")))
    return days.withColumn("_run", run).groupBy(who, "_run").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("_run")


def current_streak(events: DataFrame, today: str, who: str = "user_id", ts: str = "ts") -> DataFrame:
    """who, streak: the run that ends today or yesterday; 0 without one."""
    runs = streaks(events, who, ts)
    alive = F.col("last_day") >= F.date_sub(F.lit(today).cast("date"), 1)
    return runs.groupBy(who).agg(F.coalesce(F.max(F.when(alive, F.col("days"))), F.lit(0)).alias("streak"))
