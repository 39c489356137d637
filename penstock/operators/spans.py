"""Span algebra on tables of half-open spans (doc_id, start, end): islands, interval joins, clipping, mapping of offsets.

Every interval join carries the equality on doc_id, so it runs as a hash or sort-merge join with the overlap as a residual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import input_bytes


#: The bytes of the input's files whose spans are one task's in a join, which sorts them.
PART_BYTES = 2 << 20


def _in_parts(*sides: DataFrame) -> list[DataFrame]:
    """Both sides of a join by document, in as many parts as their files ask for: else the session's number, or what is small once packed, decides what a task sorts."""
    size = sum(map(input_bytes, sides))
    parts = max(sides[0].sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return [x.repartition(parts, "doc_id") for x in sides] if size else list(sides)


def _islands(spans: DataFrame, touching: bool, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("start") > reach if touching else F.col("start") >= reach)
    return spans.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Disjoint union of spans that overlap or touch."""
    return _islands(spans, True).groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def merge_by_priority(spans: DataFrame, priority: list[str], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Disjoint union of spans that overlap, named by the first kind of the list among them; touching ones stay apart.

    Where several rows share a doc_id, ``by`` must name what tells the texts apart; spans that are partitioned by it move no more.
    """
    rank = F.array_position(F.array(*[F.lit(k) for k in priority]), F.col("kind"))
    merged = _islands(spans.withColumn("_rank", rank), False, by).groupBy(*by, "island")
    return merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", "_rank").alias("kind")).drop("island")


def shift_spans(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Spans moved by the offset of their document; those of documents without one stay."""
    moved = spans.join(offsets.select(F.col("doc_id").alias("_d"), "offset"), F.col("doc_id") == F.col("_d"), "left")
    by = F.coalesce("offset", F.lit(0))
    return moved.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by).drop("_d", "offset")


def overlaps(a: DataFrame, b: DataFrame) -> Column:
    return (a["doc_id"] == b["doc_id"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlap(spans: DataFrame, barred: DataFrame) -> DataFrame:
    """Spans that overlap no barred span."""
    spans, b = _in_parts(spans, barred.select("doc_id", "start", "end"))
    return spans.join(b, overlaps(spans, b), "left_anti")


def with_overlap(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    spans, w = _in_parts(spans, wanted.select("doc_id", "start", "end"))
    return spans.join(w, overlaps(spans, w), "left_semi")


def fully_covered(spans: DataFrame, cover: DataFrame) -> DataFrame:
    """Spans inside one span of the merged cover."""
    spans, cover = _in_parts(spans, cover.select("doc_id", "start", "end"))
    m = merge_spans(cover)
    inside = (spans["doc_id"] == m["doc_id"]) & (m["start"] <= spans["start"]) & (spans["end"] <= m["end"])
    return spans.join(m, inside, "left_semi")


def clipped(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, window_id and the part of each span inside each window it overlaps."""
    spans, windows = _in_parts(spans, windows)
    w = windows.select(F.col("doc_id").alias("_d"), "window_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end"))
    return spans.join(w, hit).select("doc_id", "window_id", F.greatest("start", "_s").alias("start"), F.least("end", "_e").alias("end"))


def apply_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, text after replacing each edit's span; null where two edits of a document overlap."""
    e = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("e"))
    rows = docs.select("doc_id", "text").join(e, "doc_id", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,replacement:string>>")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("ok"))
    step = lambda a, x: F.struct(
        F.concat(a["out"], F.col("text").substr((a["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("int"), (x["start"] - a["at"]).cast("int"))), x["replacement"]).alias("out"),
        x["end"].alias("at"),
        (a["ok"] & (x["start"] >= a["at"])).alias("ok"),
    )
    done = F.aggregate(
        F.coalesce("e", none), start, step, lambda a: F.when(a["ok"], F.concat(a["out"], F.col("text").substr((a["at"] + 1).cast("int"), F.length("text"))))
    )
    return rows.select("doc_id", done.alias("text"))


def map_offsets(offsets: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, pos, new_pos: where an offset lies after the edits; inside an edit it snaps to the edit's start; null where two edits of the document overlap."""
    order = Window.partitionBy("_d").orderBy("_s", "_e")
    e = edits.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"), (F.length("replacement") - (F.col("end") - F.col("start"))).alias("_delta"))
    broken = e.withColumn("_bad", F.lag("_e").over(order) > F.col("_s")).groupBy("_d").agg(F.max(F.coalesce("_bad", F.lit(False))).alias("_bad")).where("_bad").select(F.col("_d").alias("_b"))
    hit = (F.col("doc_id") == F.col("_d")) & (F.col("_s") < F.col("pos"))
    joined = offsets.join(e, hit, "left")
    shift = F.sum(F.when(F.col("_e") <= F.col("pos"), F.col("_delta")).otherwise(0))
    snap = F.max(F.when((F.col("_s") < F.col("pos")) & (F.col("pos") < F.col("_e")), F.col("_s")))
    placed = joined.groupBy("doc_id", "pos").agg((F.coalesce(snap, F.col("pos")) + F.coalesce(shift, F.lit(0))).cast("long").alias("new_pos"))
    return placed.join(broken, F.col("doc_id") == F.col("_b"), "left").select("doc_id", "pos", F.when(F.col("_b").isNull(), F.col("new_pos")).alias("new_pos"))
