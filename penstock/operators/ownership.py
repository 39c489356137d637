"""Ownership, understanding and gates of a document's progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the parts, the gate's thresholds, and the origins of text.
PARTS = {"authorship": 0.45, "decisions": 0.20, "understanding": 0.20, "personalization": 0.15}
GATE = {"quiz": 70, "teach": 60, "walkthrough": 80}
ORIGINS = ("ai", "engine", "student_edit", "student_insert")


def origin_counts(runs: DataFrame) -> DataFrame:
    """doc_id and characters that are not white space by origin; untagged or unknown origins count as ai."""
    n = F.length(F.regexp_replace("text", r"\s", ""))
    origin = F.when(F.col("origin").isin(*ORIGINS), F.col("origin")).otherwise("ai")
    return runs.groupBy("doc_id").agg(*[F.sum(F.when(origin == o, n).otherwise(0)).alias(o) for o in ORIGINS])


def understanding(quiz: Column, teach: Column, got: Column, paragraphs: Column) -> Column:
    """Mean of the share of paragraphs understood, the quiz and the teach-back, 0 to 1; what is missing counts as 0."""
    walk = F.when(paragraphs > 0, got / paragraphs.cast("double")).otherwise(0.0)
    return (walk + F.coalesce(quiz, F.lit(0.0)) / 100 + F.coalesce(teach, F.lit(0.0)) / 100) / 3


def ownership(progress: DataFrame, origins: DataFrame) -> DataFrame:
    """doc_id, the parts (0 to 1), each one's points, and the score; parts that do not apply drop out and the others rescale."""
    rows = progress.join(origins, "doc_id", "left")
    size = sum((F.coalesce(F.col(o), F.lit(0)) for o in ORIGINS), F.lit(0))
    own = F.coalesce(F.col("student_edit"), F.lit(0)) + F.coalesce(F.col("student_insert"), F.lit(0))
    rows = rows.select(
        "doc_id",
        F.when(size > 0, own / size.cast("double")).otherwise(0.0).alias("authorship"),
        F.when(F.col("offered") > 0, F.least(F.lit(1.0), F.col("decided") / F.col("offered").cast("double"))).alias("decisions"),
        understanding(F.col("quiz"), F.col("teach"), F.col("got"), F.col("paragraphs")).alias("understanding"),
        F.when(F.col("spots") > 0, F.col("filled") / F.col("spots").cast("double")).alias("personalization"),
    )
    weight = sum((F.when(F.col(p).isNotNull(), w).otherwise(0.0) for p, w in PARTS.items()), F.lit(0.0))
    points = {p: 100.0 * F.col(p) * w / weight for p, w in PARTS.items()}
    total = sum((F.coalesce(x, F.lit(0.0)) for x in points.values()), F.lit(0.0))
    return rows.select("doc_id", *[F.round(p, 4).alias(p) for p in PARTS], *[F.round(x, 4).alias(f"points_{p}") for p, x in points.items()], F.round(total).cast("long").alias("ownership"))


def gate(progress: DataFrame) -> DataFrame:
    """doc_id, quiz_ok, teach_ok, walkthrough_ok, open."""
    walk = F.when(F.col("paragraphs") > 0, 100.0 * F.col("marked") / F.col("paragraphs")).otherwise(0.0)
    ok = {"quiz_ok": F.coalesce(F.col("quiz") >= GATE["quiz"], F.lit(False)), "teach_ok": F.coalesce(F.col("teach") >= GATE["teach"], F.lit(False)), "walkthrough_ok": walk >= GATE["walkthrough"]}
    return progress.select("doc_id", *[c.alias(n) for n, c in ok.items()], (ok["quiz_ok"] & ok["teach_ok"] & ok["walkthrough_ok"]).alias("open"))


def viva_summary(results: DataFrame, levels: int = 4, passed: float = 70) -> DataFrame:
    """doc_id, level, n, average for every level, with levels nobody was asked at 0."""
    asked = results.groupBy("doc_id", "level").agg(F.count("*").alias("n"), F.avg("score").alias("average"), (F.avg("score") >= passed).alias("passed"))
    all_ = results.select("doc_id").distinct().withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    return all_.join(asked, ["doc_id", "level"], "left").select("doc_id", "level", F.coalesce("n", F.lit(0)).alias("n"), F.round("average", 4).alias("average"), F.coalesce("passed", F.lit(False)).alias("passed"))


def concept_lists(results: DataFrame, weak: float = 40, strong: float = 70) -> DataFrame:
    """doc_id, concept, kind: weak concepts, and mastered ones that are not weak; case does not matter."""
    rows = results.select("doc_id", F.lower("concept").alias("concept"), "score")
    low = rows.where(F.col("score") < weak).select("doc_id", "concept").distinct()
    high = rows.where(F.col("score") >= strong).select("doc_id", "concept").distinct().join(low, ["doc_id", "concept"], "left_anti")
    return low.withColumn("kind", F.lit("weak")).unionByName(high.withColumn("kind", F.lit("mastered")))
