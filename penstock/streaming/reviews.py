"""Review logs as a stream: card states by SM-2, kept per card across micro-batches; daily counts with a watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.reviews import NEW_CARD, is_review, review

STATE = "ease double, interval double, reps int, lapses int, due double"


def stream_schedule(reviews: DataFrame) -> DataFrame:
    """card_id and its state after each micro-batch that reviews it; reviews (card_id, at_min, grade) of a batch go in order of time.

    The rules are those of the batch fold: a grade other than 1 to 4 is no review, no time comes first and gives no due time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        card = state.get if state.exists else NEW_CARD
        rows = pd.concat(list(batches)).sort_values(["at_min", "grade"], na_position="first")
        for at, grade in zip(rows["at_min"], rows["grade"]):
            card = review(card, int(grade), None if pd.isna(at) else float(at))
        state.update(card)
        yield pd.DataFrame([(key[0], *card)], columns=["card_id", "ease", "interval", "reps", "lapses", "due"])

    return reviews.where(is_review(F.col("grade"))).groupBy("card_id").applyInPandasWithState(step, f"card_id long, {STATE}", STATE, "update", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, event_type, n; days are closed once events are so late."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "event_type", "n")
